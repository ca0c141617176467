"""The results of the sample jobs stated independently as SQL.

Written for an engine with ``QUALIFY``, list functions and RE2 expressions. The statements
share a few named steps, put together with ``_with``.
"""

from __future__ import annotations

YEAR = 2001


def _slug(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '-'), '')"


def _title(x: str) -> str:
    words = f"regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"array_to_string(list_transform({words}, lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')"


def _raw(coarse: bool) -> str:
    if coarse:
        mileage = "CAST(floor(l_quantity / 10) * 50000 AS BIGINT)"
        price = "CAST(floor(l_extendedprice / 5000) * 5000 AS DOUBLE)"
        seller = "CAST(NULL AS VARCHAR)"
    else:
        mileage = "CASE WHEN l_linenumber <> 6 THEN CAST(floor(l_quantity * 5000) AS BIGINT) END"
        price = "l_extendedprice * CAST(2.6 AS DOUBLE) - CAST(2000 AS DOUBLE)"
        seller = "s_name"
    return f"""
      SELECT 'src_' || CAST(l_orderkey % 3 AS VARCHAR) AS source,
        CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS listing_id,
        'https://ads.example/' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
          || '/?ref=' || CAST(l_suppkey AS VARCHAR) AS url,
        concat_ws(' ', p_brand, p_type, p_name) AS title,
        p_brand AS make, p_type AS model, p_name AS version, {price} AS price_value,
        CASE WHEN l_tax = 0 THEN 'RON' ELSE 'EUR' END AS currency, l_returnflag AS price_indicator,
        {seller} AS seller_name, n_name AS location_city, r_name AS location_region,
        CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS reg_month,
        {mileage} AS mileage_km, o_orderpriority AS fuel_type, l_linestatus AS transmission,
        CAST(p_size * 12 AS BIGINT) AS power_hp,
        CASE WHEN l_linenumber <> 5 THEN CAST(floor((p_retailprice - 900) * 100) AS BIGINT) END AS engine_capacity_cm3,
        strftime(l_shipdate, '%Y-%m-%d') AS scraped_at,
        l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""


_POS = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount"
_POS_DESC = ", ".join(f"{c} DESC" for c in _POS.split(", "))

_TYPED = f"""
      SELECT source, source || ':' || listing_id AS source_listing_key, listing_id, url, title, make, model, version,
        year, reg_month AS first_registration_month, year AS first_registration_year, mileage_km,
        CASE WHEN currency = 'EUR' THEN price_value END AS price_eur, price_value AS original_price_value,
        currency AS original_currency, {_slug('price_indicator')} AS market_price_label,
        {_slug('fuel_type')} AS fuel_type, {_slug('transmission')} AS transmission,
        CAST(NULL AS VARCHAR) AS body_type, power_hp, engine_capacity_cm3, CAST(NULL AS VARCHAR) AS seller_type,
        seller_name, {_title('location_city')} AS location_city, {_title('location_region')} AS location_region,
        scraped_at, {_POS}
      FROM raw"""

_NORM = f"""
      SELECT *,
        CAST((make <> '')::INT + (model <> '')::INT + (version <> '')::INT + (year <> 0)::INT
          + coalesce((mileage_km <> 0)::INT, 0) + coalesce((price_eur <> 0)::INT, 0) + (fuel_type IS NOT NULL)::INT
          + (transmission IS NOT NULL)::INT + (body_type IS NOT NULL)::INT + coalesce((power_hp <> 0)::INT, 0)
          + coalesce((engine_capacity_cm3 <> 0)::INT, 0) + (seller_type IS NOT NULL)::INT
          + (location_city <> '')::INT AS BIGINT) AS completeness_score,
        source_listing_key AS dedupe_exact_key,
        CASE WHEN mileage_km <> 0 AND price_eur <> 0 AND year <> 0 THEN
          concat_ws('|', {_slug('make')}, {_slug('model')}, CAST(year AS VARCHAR), CAST(mileage_km AS VARCHAR),
            CAST(CAST(round_even(price_eur, 0) AS BIGINT) AS VARCHAR),
            coalesce({_slug('seller_name')}, {_slug('location_city')})) END AS dedupe_fuzzy_key
      FROM typed"""

_EXACT = f"""
      SELECT * FROM (
        SELECT *, count(*) OVER (PARTITION BY source_listing_key) AS copies,
          row_number() OVER (PARTITION BY source_listing_key ORDER BY {_POS}) AS seen,
          row_number() OVER (PARTITION BY source_listing_key
            ORDER BY completeness_score DESC, scraped_at DESC, {_POS_DESC}) AS rank,
          first_value({{'a': l_shipdate, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice, 'e': l_quantity, 'f': l_discount}})
            OVER (PARTITION BY source_listing_key ORDER BY {_POS}) AS first_seen
        FROM norm) WHERE rank = 1"""

_FUZZY = """
      SELECT * FROM (
        SELECT *, sum(copies) OVER (PARTITION BY near) AS all_copies, count(*) OVER (PARTITION BY near) AS survivors,
          row_number() OVER (PARTITION BY near ORDER BY completeness_score DESC, scraped_at DESC, first_seen DESC) AS near_rank
        FROM (SELECT *, coalesce('f|' || dedupe_fuzzy_key, 'e|' || source_listing_key) AS near FROM best))
      WHERE near_rank = 1"""

_PLAUSIBLE = f"""
      SELECT * FROM best WHERE price_eur BETWEEN 750 AND 250000 AND coalesce(year, 0) BETWEEN 1995 AND {YEAR}
        AND coalesce(mileage_km, 0) BETWEEN 0 AND 500000 AND (power_hp IS NULL OR power_hp BETWEEN 30 AND 900)
        AND (engine_capacity_cm3 IS NULL OR engine_capacity_cm3 BETWEEN 600 AND 8000)"""

_CLEAN = """
      SELECT * FROM plausible
      WHERE price_eur >= (SELECT quantile_cont(price_eur, 0.01) FROM plausible)
        AND price_eur <= (SELECT quantile_cont(price_eur, 0.995) FROM plausible)"""


def _features(source: str) -> str:
    return f"""
      SELECT *, make || ' ' || model AS make_model, greatest({YEAR} - year, 0) AS vehicle_age,
        CAST(mileage_km AS DOUBLE) / nullif(CAST(greatest({YEAR} - year, 0) AS DOUBLE), 0) AS mileage_per_year,
        CAST(power_hp AS DOUBLE) / nullif(CAST(engine_capacity_cm3 AS DOUBLE) / 1000.0::DOUBLE, 0) AS hp_per_liter
      FROM {source}"""


_MEANS = """
      SELECT *, avg(price_eur) OVER (PARTITION BY make) AS mean_of_make,
        avg(price_eur) OVER (PARTITION BY make, model) AS mean_of_model,
        avg(price_eur) OVER (PARTITION BY year) AS mean_of_year, avg(price_eur) OVER () AS voting_ensemble
      FROM frame"""

_MODELS = ["mean_of_make", "mean_of_model", "mean_of_year", "voting_ensemble"]

_PRED = " UNION ALL ".join(
    f"SELECT source_listing_key, price_eur AS actual, '{m}' AS model, {m} AS predicted FROM means" for m in _MODELS
)

_METRICS = """
      SELECT model, count(*) AS rows, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
        avg(abs(actual - predicted)) AS mae,
        1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2
      FROM pred GROUP BY model"""

_CANDIDATES = """
      SELECT p.source_listing_key, p.model, p.predicted, m.mae, m.rmse FROM pred p JOIN metrics m ON p.model = m.model
      WHERE p.model <> 'voting_ensemble' AND p.predicted > 0"""

_CENTER = """
      SELECT source_listing_key, median(predicted) AS center FROM cand GROUP BY 1"""

_SPREAD = """
      SELECT c.source_listing_key, any_value(t.center) AS center,
        greatest(median(abs(c.predicted - t.center)) * 2.5, any_value(t.center) * 0.15, 1) AS scale
      FROM cand c JOIN center t USING (source_listing_key) GROUP BY 1"""

_WEIGHTED = """
      SELECT c.*, exp(-abs(c.predicted - s.center) / s.scale) AS agreement,
        CASE WHEN c.mae > 0 THEN 1 / c.mae WHEN c.rmse > 0 THEN 1 / c.rmse ELSE 1 END AS skill
      FROM cand c JOIN spread s USING (source_listing_key)"""

_COMBINED = """
      SELECT source_listing_key, sum(predicted * skill * agreement) / sum(skill * agreement) AS predicted,
        sum(predicted * skill) / sum(skill) AS plain
      FROM weighted GROUP BY 1"""

_VERDICT = """
      SELECT f.*, c.predicted AS final,
        CASE WHEN f.price_eur IS NULL OR c.predicted <= 0 THEN 'unknown'
          WHEN f.price_eur < c.predicted * (1.0::DOUBLE - 0.15::DOUBLE) THEN 'too_low_suspicious'
          WHEN f.price_eur > c.predicted * (1.0::DOUBLE + 0.15::DOUBLE) THEN 'too_high' ELSE 'fair' END AS verdict
      FROM frame f JOIN combined c USING (source_listing_key)"""

_STEPS = {
    "raw": _raw(False), "coarse": _raw(True), "typed": _TYPED, "norm": _NORM, "best": _EXACT, "near": _FUZZY,
    "plausible": _PLAUSIBLE, "clean": _CLEAN, "frame": _features("clean"), "means": _MEANS, "pred": _PRED,
    "metrics": _METRICS, "cand": _CANDIDATES, "center": _CENTER, "spread": _SPREAD, "weighted": _WEIGHTED,
    "combined": _COMBINED, "judged": _VERDICT,
}
_BEST = ["raw", "typed", "norm", "best"]
_FRAME = [*_BEST, "plausible", "clean", "frame"]
_PREDICTED = [*_FRAME, "means", "pred", "metrics"]
_ENSEMBLE = [*_PREDICTED, "cand", "center", "spread", "weighted", "combined"]

_LISTING = """source, source_listing_key, listing_id, url, title, make, model, version, year, first_registration_month,
  first_registration_year, mileage_km, price_eur, original_price_value, original_currency, market_price_label, fuel_type,
  transmission, body_type, power_hp, engine_capacity_cm3, seller_type, seller_name, location_city, location_region,
  scraped_at, completeness_score, dedupe_exact_key, dedupe_fuzzy_key"""


def _with(steps: list[str], select: str, coarse: bool = False, extra: dict[str, str] | None = None) -> str:
    parts = [f"{n} AS MATERIALIZED ({_STEPS['coarse' if coarse and n == 'raw' else n]})" for n in steps]
    parts += [f"{n} AS MATERIALIZED ({body})" for n, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


def _bins(value: str, source: str) -> str:
    edges = ", ".join(f"quantile_cont({value}, {i / 5})" for i in range(6))
    return f"SELECT list_sort(list_distinct([{edges}])) AS e FROM {source}"


_BIN_OF = "CAST(len(list_filter(e[2:len(e) - 1], lambda x: price_eur > x)) AS BIGINT)"

_NUMERIC = ["year", "vehicle_age", "first_registration_month", "first_registration_year", "mileage_km",
            "mileage_per_year", "power_hp", "engine_capacity_cm3", "hp_per_liter"]
_CATEGORICAL = ["make", "model", "make_model", "version", "fuel_type", "transmission", "location_city",
                "location_region"]
_CORRELATED = ["year", "mileage_km", "power_hp", "engine_capacity_cm3", "price_eur"]


def _pearson() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count({f}) AS sample_size, count(DISTINCT {f}) AS unique_values, "
        f"round(corr(CAST({f} AS DOUBLE), price_eur), 8) AS r FROM frame" for f in _NUMERIC
    )


def _cramers() -> str:
    parts = []
    for f in _CATEGORICAL:
        parts.append(f"""
        SELECT '{f}' AS feature, CAST(n AS BIGINT) AS sample_size, r AS unique_values, c AS bins_used,
          (r - 1) * (c - 1) AS dof, round(chi2, 4) AS chi2, round(sqrt(chi2 / n / greatest(1, least(r - 1, c - 1))), 8) AS cramers_v
        FROM (
          SELECT any_value(n) AS n, count(DISTINCT v) AS r, count(DISTINCT b) AS c,
            any_value(n) * (sum(CAST(o AS DOUBLE) * o / (rt * ct)) - 1) AS chi2
          FROM (
            SELECT v, b, o, sum(o) OVER (PARTITION BY v) AS rt, sum(o) OVER (PARTITION BY b) AS ct, sum(o) OVER () AS n
            FROM (
              SELECT {f} AS v, {_BIN_OF} AS b, count(*) AS o
              FROM frame, ({_bins('price_eur', f'frame WHERE {f} IS NOT NULL')}) WHERE {f} IS NOT NULL GROUP BY ALL)))""")
    return " UNION ALL ".join(parts)


def _correlations() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, "
        + ("CAST(max(1) AS DOUBLE)" if a == b else f"round(corr({min(a, b, key=_CORRELATED.index)}, {max(a, b, key=_CORRELATED.index)}), 8)")
        + " AS correlation FROM frame"
        for a in _CORRELATED for b in _CORRELATED
    )


def _numeric_fit(columns: list[str], source: str, by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    parts = []
    for c in columns:
        parts.append(f"""
        SELECT {keys}'{c}' AS "column", round(any_value(med), 4) AS median, round(avg(coalesce({c}, med)), 4) AS mean,
          round(CASE WHEN stddev_pop(coalesce({c}, med)) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, med)) END, 4) AS scale
        FROM (SELECT {keys}CAST({c} AS DOUBLE) AS {c}, median({c}) OVER ({over}) AS med FROM {source})
        {'GROUP BY ' + by if by else ''}""")
    return " UNION ALL ".join(parts)


def _modes(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", {c} AS mode FROM {source} WHERE {c} IS NOT NULL
        GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)""" for c in columns
    )


def _enum_case(slug: str, pairs: dict[str, str | None]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {'NULL' if v is None else repr(v)}" for k, v in pairs.items())
    return f"CASE {slug} {cases} ELSE {slug} END"


def _enum_map() -> str:
    fuels = "['Diesel', 'Motorină', ' benzină ', 'Hibrid  Plug-In', 'Electro', 'GPL', 'Wasserstoff', '---']"
    gears = "['Automată', 'manuală', 'Schaltgetriebe', 'Semi automatic', 'halbautomatik']"
    labels = "['none', 'Sehr guter Preis', 'Erhöhter Preis', 'Ohne Bewertung', 'above', 'strange one', 'in']"
    fuel = {"diesel": "diesel", "motorina": "diesel", "benzina": "petrol", "hibrid-plug-in": "plug_in_hybrid",
            "electro": "electric", "gpl": "lpg"}
    gear = {"automata": "automatic", "manuala": "manual", "schaltgetriebe": "manual", "halbautomatik": "semi_automatic"}
    label = {"none": None, "sehr-guter-preis": "low", "erhohter-preis": "high", "ohne-bewertung": None,
             "above": "high", "in": "fair"}
    return f"""
    SELECT raw_fuel, raw_gear, raw_label, {_enum_case(_slug('raw_fuel'), fuel)} AS fuel_type,
      {_enum_case(_slug('raw_gear'), gear)} AS transmission, {_enum_case(_slug('raw_label'), label)} AS market_price_label,
      count(*) AS rows
    FROM (SELECT {fuels}[l_partkey % 8 + 1] AS raw_fuel, {gears}[l_suppkey % 5 + 1] AS raw_gear,
      {labels}[l_linenumber % 7 + 1] AS raw_label FROM lineitem) GROUP BY ALL"""


def _bin_table(select: str) -> str:
    return f"""SELECT {select} FROM (SELECT *, {_BIN_OF} AS target_bin FROM frame, ({_bins('price_eur', 'frame')}))
    GROUP BY target_bin"""


def _split() -> str:
    sizes = _bin_table("target_bin, count(*) AS n")
    return f""",
    sizes AS ({sizes}),
    shares AS (SELECT target_bin, n, ceil(0.2 * sum(n) OVER ()) AS wanted, ceil(0.2 * sum(n) OVER ()) * n / sum(n) OVER () AS exact FROM sizes),
    ranked AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY floor(exact) - exact, target_bin) AS place,
      wanted - sum(floor(exact)) OVER () AS spare FROM shares)
    SELECT target_bin, n AS rows, CAST(base + (place <= spare)::INT AS BIGINT) AS test_rows FROM ranked"""


_REQUESTS = """
      SELECT DISTINCT 'https://ads.example/' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber + 2 AS VARCHAR)
        || '/?from=mail' AS url, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS wanted_id
      FROM lineitem"""


def _first_hits(where: str = "true") -> dict[str, str]:
    key = "rtrim(split_part({0}, '?', 1), '/')"
    return {
        "asked": _REQUESTS,
        "by_url": f"""SELECT {key.format('url')} AS k, arg_min(source_listing_key, first_seen) AS hit FROM best
          WHERE {where} GROUP BY 1""",
        "by_id": f"SELECT listing_id AS k, arg_min(source_listing_key, first_seen) AS hit FROM best WHERE {where} GROUP BY 1",
        "hits": f"""SELECT a.url, a.wanted_id, coalesce(u.hit, i.hit) AS found_key,
            CASE WHEN u.hit IS NOT NULL THEN 'url' WHEN i.hit IS NOT NULL THEN 'id' END AS matched_by
          FROM asked a LEFT JOIN by_url u ON {key.format('a.url')} = u.k LEFT JOIN by_id i ON a.wanted_id = i.k""",
    }


def _ordered_hits() -> dict[str, str]:
    steps: dict[str, str] = {"asked": _REQUESTS}
    key = "rtrim(split_part({0}, '?', 1), '/')"
    for i in (0, 1):
        steps[f"u{i}"] = f"""SELECT {key.format('url')} AS k, arg_min(source_listing_key, first_seen) AS hit FROM best
          WHERE source = 'src_{i}' GROUP BY 1"""
        steps[f"i{i}"] = f"""SELECT listing_id AS k, arg_min(source_listing_key, first_seen) AS hit FROM best
          WHERE source = 'src_{i}' GROUP BY 1"""
    steps["hits"] = f"""SELECT a.url, a.wanted_id, coalesce(u0.hit, i0.hit, u1.hit, i1.hit) AS found_key,
        CASE WHEN coalesce(u0.hit, i0.hit) IS NOT NULL THEN 'src_0' WHEN coalesce(u1.hit, i1.hit) IS NOT NULL THEN 'src_1' END AS found_in
      FROM asked a LEFT JOIN u0 ON {key.format('a.url')} = u0.k LEFT JOIN i0 ON a.wanted_id = i0.k
        LEFT JOIN u1 ON {key.format('a.url')} = u1.k LEFT JOIN i1 ON a.wanted_id = i1.k"""
    return steps


def _position_hits(sources: tuple[int, ...]) -> dict[str, str]:
    """Per request and source the earliest row with its URL or its id; the first source that has one counts."""
    key = "rtrim(split_part({0}, '?', 1), '/')"
    steps = {"asked": _REQUESTS}
    for i in sources:
        steps[f"both{i}"] = f"""SELECT a.url, a.wanted_id, b.source_listing_key AS hit, b.first_seen AS place, 'url' AS kind
            FROM asked a JOIN best b ON {key.format('a.url')} = {key.format('b.url')} WHERE b.source = 'src_{i}'
          UNION ALL SELECT a.url, a.wanted_id, b.source_listing_key, b.first_seen, 'id'
            FROM asked a JOIN best b ON a.wanted_id = b.listing_id WHERE b.source = 'src_{i}'"""
        steps[f"hit{i}"] = f"""SELECT url, wanted_id, arg_min(hit, place) AS hit,
            CASE WHEN arg_min(hit, place) = arg_min(hit, place) FILTER (kind = 'url')
              THEN 'url' ELSE 'id' END AS kind
          FROM both{i} x GROUP BY url, wanted_id"""
    names = [f"h{i}" for i in sources]
    joins = " ".join(f"LEFT JOIN hit{i} h{i} ON h{i}.url = a.url AND h{i}.wanted_id = a.wanted_id" for i in sources)
    where = " ".join(f"WHEN h{i}.hit IS NOT NULL THEN 'src_{i}'" for i in sources)
    steps["hits"] = f"""SELECT a.url, a.wanted_id, coalesce({", ".join(f"{n}.hit" for n in names)}) AS found_key,
        coalesce({", ".join(f"{n}.kind" for n in names)}) AS matched_by, CASE {where} END AS found_in FROM asked a {joins}"""
    return steps


def _similar(final: str = "SELECT * FROM top") -> str:
    """Steps after ``best``; ``top`` holds the comparable listings of every listing."""
    numeric = ["year", "mileage_km", "power_hp", "engine_capacity_cm3", "price_eur"]
    words = ["make", "model", "version", "fuel_type", "transmission", "body_type", "seller_type"]
    fits = ", ".join(f"median({c}) OVER (PARTITION BY pool) AS med_{c}" for c in numeric)
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), med_{c}) AS f_{c}" for c in numeric)
    moments = ", ".join(
        f"avg(f_{c}) AS m_{c}, CASE WHEN stddev_pop(f_{c}) = 0 THEN 1 ELSE stddev_pop(f_{c}) END AS s_{c}" for c in numeric
    )
    modes = ",\n".join(
        f"""mode_{c} AS (SELECT pool, arg_min(v, {{'a': -n, 'b': v}}) AS mode_{c} FROM
          (SELECT pool, {c} AS v, count(*) AS n FROM member WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY pool)"""
        for c in words
    )
    scaled = ", ".join(f"coalesce((coalesce(CAST(r.{c} AS DOUBLE), p.med_{c}) - p.m_{c}) / p.s_{c}, 0) AS z_{c}" for c in numeric)
    coded = ", ".join(f"coalesce(r.{c}, w_{c}.mode_{c}, '') AS w_{c}" for c in words)
    joins = " ".join(f"LEFT JOIN mode_{c} w_{c} ON w_{c}.pool = r.pool" for c in words)
    gaps = " + ".join(f"(q.z_{c} - c.z_{c}) * (q.z_{c} - c.z_{c})" for c in numeric)
    misses = " + ".join(f"(q.w_{c} <> c.w_{c})::INT" for c in words)

    def same(c: str) -> str:
        return f"coalesce(lower(nullif(q.{c}, '')) = lower(nullif(c.{c}, '')), false)"

    def close(c: str, t: int) -> str:
        return f"coalesce(abs(q.{c} - c.{c}) <= {t}, false)"

    checks = [
        (same("make"), "same make"), (same("model"), "same model"), (same("fuel_type"), "same fuel"),
        (same("transmission"), "same gearbox"), (close("year", 1), "year within 1"),
        (close("mileage_km", 25000), "mileage within 25k km"), (close("power_hp", 20), "power within 20 hp"),
        (close("engine_capacity_cm3", 250), "engine within 250 cm3"),
    ]
    reasons = "[" + ", ".join(f"CASE WHEN {t} THEN '{x}' END" for t, x in checks) + "]"
    return f""",
    sized AS (SELECT *, 'model|' || lower(make) || '|' || lower(model) AS pm, 'make|' || lower(make) AS pk,
      count(*) OVER (PARTITION BY lower(make), lower(model)) AS nm, count(*) OVER (PARTITION BY lower(make)) AS nk FROM best),
    query AS (SELECT *, CASE WHEN nm >= 5 THEN pm WHEN nk >= 8 THEN pk ELSE 'all' END AS pool FROM sized),
    member AS (SELECT * FROM (SELECT *, unnest([pm, pk, 'all']) AS pool FROM sized) WHERE pool IN (SELECT pool FROM query)),
    med AS (SELECT *, {fits} FROM member),
    fill AS (SELECT *, {filled} FROM med),
    fit AS (SELECT pool, {", ".join(f"any_value(med_{c}) AS med_{c}" for c in numeric)}, {moments} FROM fill GROUP BY pool),
    {modes},
    q AS (SELECT r.*, {scaled}, {coded} FROM query r JOIN fit p ON p.pool = r.pool {joins}),
    c AS (SELECT r.*, {scaled}, {coded} FROM member r JOIN fit p ON p.pool = r.pool {joins}),
    pairs AS (SELECT q.source_listing_key AS query_key, c.source_listing_key AS similar_key, q.url AS q_url,
        {gaps} + 2 * ({misses}) AS d2, list_filter({reasons}, lambda x: x IS NOT NULL)[1:4] AS reasons,
        c.title, c.url, c.price_eur, c.year, c.mileage_km, c.fuel_type
      FROM q JOIN c ON q.pool = c.pool
      QUALIFY row_number() OVER (PARTITION BY q.source_listing_key ORDER BY round({gaps} + 2 * ({misses}), 9), c.source_listing_key) <= 12),
    others AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(d2, 9), similar_key) AS position
      FROM pairs WHERE query_key <> similar_key AND url <> q_url),
    top AS (SELECT query_key, position, similar_key, title, url, price_eur, year, mileage_km, fuel_type,
      round_even(least(100, greatest(0, exp(-sqrt(greatest(round(d2, 9), 0)) / 2.2) * 100)), 1) AS similarity_score,
      CASE WHEN list_contains(reasons, 'same model') AND list_contains(reasons, 'mileage within 25k km') THEN 'very_close'
        WHEN len(reasons) >= 3 THEN 'close' ELSE 'broad_match' END AS match_quality,
      array_to_string(reasons, '|') AS match_reasons
    FROM others WHERE position <= 5)
    {final}"""


def _core() -> dict[str, str]:
    r2 = lambda c, n=None: f"round({c}, 2) AS {n or c}"
    return {
        "normalize_listings": _with(["raw", "typed", "norm"], f"SELECT {_LISTING} FROM norm"),
        "dedupe_exact": _with(_BEST, f"SELECT {_LISTING}, copies FROM best"),
        "best_records_stream": _with(_BEST, f"SELECT {_LISTING} FROM best"),
        "dedupe_fuzzy": _with(
            [*_BEST, "near"],
            """SELECT source_listing_key, dedupe_fuzzy_key, price_eur, mileage_km, completeness_score, scraped_at,
            CAST(all_copies AS BIGINT) AS copies, survivors FROM near""", coarse=True),
        "dedupe_report": _with(
            [*_BEST, "near"],
            """SELECT (SELECT count(*) FROM norm) AS loaded_rows, (SELECT count(*) FROM norm) AS normalized_rows,
            (SELECT count(*) FROM near) AS kept_rows,
            (SELECT count(*) FROM norm) - (SELECT count(*) FROM best) AS exact_duplicates_removed,
            (SELECT count(*) FROM best) - (SELECT count(*) FROM near) AS fuzzy_duplicates_removed,
            count(*) FILTER (price_eur IS NULL) AS rows_missing_price, count(*) FILTER (year IS NULL) AS rows_missing_year,
            count(*) FILTER (mileage_km IS NULL) AS rows_missing_mileage FROM near""", coarse=True),
        "keep_first_per_run": _with(
            ["raw"], f"""SELECT listing_id, url, scraped_at, price_value FROM raw
            QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY {_POS}) = 1"""),
        "union_of_inputs": _with(["raw"], "SELECT source, count(*) AS rows FROM raw GROUP BY 1"),
        "distinct_union": _with(
            ["raw", "typed", "norm"],
            """SELECT make, model, fuel_type, year FROM norm WHERE year <= 1998 UNION
            SELECT make, model, fuel_type, year FROM norm WHERE year >= 1998"""),
        "enum_map": _enum_map(),
        "make_from_title": """
            SELECT p_partkey, title,
              ['Land Rover', 'BMW', 'Mercedes-Benz', 'Opel'][k] AS make,
              CASE WHEN k = 2 THEN 'Seria ' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS model, p_name AS version
            FROM (SELECT *, p_partkey % 4 + 1 AS k, concat_ws('  ',
              ['Land Rover', 'bmw Seria', 'Mercedes-Benz', 'Opel'][p_partkey % 4 + 1], CAST(p_size AS VARCHAR), p_name) AS title FROM part)""",
        "clean_training": _with(
            [*_BEST, "plausible", "clean"],
            "SELECT source_listing_key, price_eur, year, mileage_km, power_hp, engine_capacity_cm3 FROM clean"),
        "price_trim": _with(
            [*_BEST, "plausible"],
            """SELECT count(*) AS n, round(quantile_cont(price_eur, 0.01), 4) AS low,
            round(quantile_cont(price_eur, 0.995), 4) AS high, round(quantile_cont(price_eur, 0.5), 4) AS median FROM plausible"""),
        "enrich": _with(_FRAME, "SELECT source_listing_key, make_model, vehicle_age, mileage_per_year, hp_per_liter FROM frame"),
        "scoring_payload": _with(
            _BEST, """SELECT source_listing_key, make_model, vehicle_age, mileage_per_year, hp_per_liter, year, fuel_type FROM features""",
            extra={"features": _features("best")}),
        "available_features": _with(
            _BEST, "SELECT count(make) AS make, count(fuel_type) AS fuel_type, count(mileage_km) AS mileage_km FROM best"),
        "cleaning_summary": _with(
            _FRAME, "SELECT min(price_eur) AS price_min, max(price_eur) AS price_max, min(year) AS year_min, max(year) AS year_max FROM frame"),
        "target_bins": _with(_FRAME, _bin_table("target_bin, count(*) AS rows, min(price_eur) AS lowest, max(price_eur) AS highest")),
        "pearson": _with(_FRAME, _pearson()),
        "cramers_v": _with(_FRAME, _cramers()),
        "correlation_matrix": _with(_FRAME, _correlations()),
        "price_histogram": _histogram("price_eur"),
        "mileage_histogram": _histogram("mileage_km"),
        "rows_by_source": _with(_BEST, "SELECT source, count(*) AS rows FROM best GROUP BY 1"),
        "top_makes": _with(_BEST, "SELECT make, count(*) AS rows FROM best GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "median_price_by_year": _with(
            _BEST, "SELECT year, count(price_eur) AS rows, round(median(price_eur), 4) AS median_price_eur FROM best WHERE price_eur IS NOT NULL GROUP BY 1"),
        "median_price_by_make": _with(
            _BEST, "SELECT make, count(price_eur) AS rows, round(median(price_eur), 4) AS median_price_eur FROM best WHERE price_eur IS NOT NULL GROUP BY 1"),
        "distinct_makes_models": _with(
            _BEST, "SELECT count(DISTINCT make) AS distinct_makes, count(DISTINCT (make, model)) AS distinct_models FROM best"),
        "field_coverage": _with(
            _BEST, """SELECT source, count(*) AS rows, count(price_eur) AS with_price_eur, count(mileage_km) AS with_mileage_km,
            count(engine_capacity_cm3) AS with_engine_capacity_cm3, count(body_type) AS with_body_type,
            count(seller_name) AS with_seller_name FROM best GROUP BY 1"""),
        "price_mileage_grid": _with(
            _BEST, """SELECT fuel_type, CAST(floor(mileage_km / 25000) * 25000 AS BIGINT) AS mileage_from,
            CAST(floor(price_eur / 5000) * 5000 AS BIGINT) AS price_from, count(*) AS rows FROM best
            WHERE mileage_km IS NOT NULL AND price_eur IS NOT NULL GROUP BY ALL"""),
        "imputation_values": _with(_FRAME, _numeric_fit(_CORRELATED, "frame")),
        "most_frequent_values": _with(_BEST, _modes(["make", "model", "version", "fuel_type", "transmission"], "best")),
        "imputation_values_by_make": _with(_BEST, _numeric_fit(["year", "mileage_km", "price_eur"], "best", "make")),
        "stratified_split": _with(_FRAME, "") + _split(),
        "candidate_pools": _with(
            _BEST, """SELECT pool, tier, count(*) AS queries FROM (
              SELECT CASE tier WHEN 'model' THEN 'model|' || lower(make) || '|' || lower(model) WHEN 'make' THEN 'make|' || lower(make) ELSE 'all' END AS pool, tier
              FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY make, model) >= 5 THEN 'model'
                WHEN count(*) OVER (PARTITION BY make) >= 8 THEN 'make' ELSE 'all' END AS tier FROM best)) GROUP BY ALL"""),
        "similar_topk": _with(_BEST, "") + _similar(),
        "holdout_table": _with(
            _PREDICTED, f"""SELECT source_listing_key, model, actual AS actual_price_eur, {r2('predicted', 'predicted_price_eur')},
            round(abs(actual - predicted), 2) AS abs_error_eur FROM pred"""),
        "holdout_metrics": _with(
            _PREDICTED, "SELECT model, rows, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 8) AS r2 FROM metrics"),
        "best_model": _with(_PREDICTED, "SELECT model AS best_model, round(rmse, 4) AS best_rmse FROM metrics ORDER BY rmse, model LIMIT 1"),
        "residual_profile": _with(
            _PREDICTED, f"""SELECT model, price_band, count(*) AS rows, {r2('avg(d)', 'mean_residual')}, {r2('stddev_pop(d)', 'sd_residual')},
            {r2('min(d)', 'min_residual')}, {r2('max(d)', 'max_residual')} FROM (
              SELECT model, actual - predicted AS d, {_BIN_OF.replace('price_eur', 'actual')} AS price_band FROM pred, ({_bins('actual', 'pred')}))
            GROUP BY ALL"""),
        "ensemble_agreement": _with(_ENSEMBLE, f"SELECT source_listing_key, {r2('predicted', 'predicted_price_eur')} FROM combined"),
        "ensemble_inverse_mae": _with(_ENSEMBLE, f"SELECT source_listing_key, {r2('plain', 'predicted_price_eur')} FROM combined"),
        "ensemble_weights": _with(
            _ENSEMBLE, """SELECT p.source_listing_key, p.model,
            round(w.skill * w.agreement / sum(w.skill * w.agreement) OVER (PARTITION BY p.source_listing_key), 6) AS ensemble_weight,
            round(w.agreement, 6) AS agreement_weight,
            CASE WHEN p.model = 'voting_ensemble' THEN 'prevents_double_counting' END AS exclusion_reason
            FROM pred p LEFT JOIN weighted w USING (source_listing_key, model)"""),
        "estimate_spread": _with(
            _PREDICTED, f"""SELECT source_listing_key, {r2('any_value(m)', 'median')}, {r2('median(abs(predicted - m))', 'mad')} FROM (
              SELECT *, median(predicted) OVER (PARTITION BY source_listing_key) AS m FROM pred) GROUP BY 1"""),
        "price_report": _with(
            [*_ENSEMBLE, "judged"], f"""SELECT source_listing_key, source, title, price_eur AS actual_price_eur,
            {r2('final', 'predicted_price_eur')}, {r2('price_eur - final', 'delta_eur')},
            round((price_eur - final) / final * 100, 4) AS delta_percent, verdict, 'weighted_average' AS first_model,
            CAST(5 AS BIGINT) AS estimates, CAST(0 AS BIGINT) AS similar FROM judged"""),
        "report_with_similar": _with([*_ENSEMBLE, "judged"], "") + _similar(f"""
            SELECT j.source_listing_key, verdict, {r2('final', 'predicted_price_eur')}, t.position, t.title AS similar_title, t.url AS similar_url,
              t.price_eur AS similar_price_eur, t.similarity_score, t.match_quality, t.match_reasons
            FROM judged j LEFT JOIN top t ON t.query_key = j.source_listing_key"""),
        "verdict_by_label": _with(
            [*_ENSEMBLE, "judged"], """SELECT market_price_label, count(*) FILTER (verdict = 'too_low_suspicious') AS too_low_suspicious,
            count(*) FILTER (verdict = 'fair') AS fair, count(*) FILTER (verdict = 'too_high') AS too_high,
            count(*) FILTER (verdict = 'unknown') AS unknown, count(*) AS rows FROM judged GROUP BY 1"""),
        "lookup_by_url_or_id": _with(_BEST, "SELECT * FROM hits", extra=_first_hits()),
        "lookup_by_position": _with(_BEST, "SELECT url, wanted_id, found_key, matched_by FROM hits", extra=_position_hits((1,))),
        "lookup_all_sources": _with(_BEST, "SELECT url, wanted_id, found_key, found_in FROM hits", extra=_position_hits((2, 1, 0))),
        "lookup_in_order": _with(_BEST, "SELECT * FROM hits", extra=_ordered_hits()),
        "unresolved_requests": _with(_BEST, "SELECT url, wanted_id FROM hits WHERE found_in IS NULL", extra=_ordered_hits()),
        "history_latest": _with(
            [*_ENSEMBLE, "judged"], """SELECT user_id, created_at, 'inverse_mae_with_agreement' AS ensemble_method,
            CAST(15 AS DOUBLE) AS threshold_percent FROM (
              SELECT CAST(regexp_extract(source_listing_key, ':(\\d+)-', 1) AS BIGINT) % 50 AS user_id,
                scraped_at || 'T00:00:00+00:00' AS created_at FROM judged)
            WHERE user_id = 7 ORDER BY created_at DESC LIMIT 20"""),
        "history_summary": _with(
            [*_ENSEMBLE, "judged"], """SELECT CAST(regexp_extract(source_listing_key, ':(\\d+)-', 1) AS BIGINT) % 50 AS user_id, verdict,
            'inverse_mae_with_agreement' AS ensemble_method, 'weighted_average' AS model_name, count(*) AS rows,
            CAST(0 AS BIGINT) AS similar, CAST(15 AS DOUBLE) AS threshold FROM judged GROUP BY ALL"""),
        "history_detail": _with(
            [*_ENSEMBLE, "judged"], """SELECT CAST(7 AS BIGINT) AS user_id, title, verdict, CAST(5 AS BIGINT) AS estimates FROM judged
            WHERE CAST(regexp_extract(source_listing_key, ':(\\d+)-', 1) AS BIGINT) % 50 = 7"""),
        "history_delete": _with(
            [*_ENSEMBLE, "judged"], """SELECT count(*) FILTER (u <> 7) AS kept, count(*) FILTER (u = 7) AS removed FROM (
              SELECT CAST(regexp_extract(source_listing_key, ':(\\d+)-', 1) AS BIGINT) % 50 AS u FROM judged)"""),
        "history_table": _with(
            [*_ENSEMBLE, "judged"], """SELECT u AS user_id, count(*) AS rows, min(created) AS oldest, max(created) AS newest,
            count(*) FILTER (verdict = 'fair') AS fair, (SELECT count(*) FROM judged
              WHERE CAST(regexp_extract(source_listing_key, ':(\\d+)-', 1) AS BIGINT) % 50 IN (7, 11)) AS removed
            FROM (SELECT CAST(regexp_extract(source_listing_key, ':(\\d+)-', 1) AS BIGINT) % 50 AS u, verdict,
              scraped_at || 'T00:00:00+00:00' AS created FROM judged) WHERE u NOT IN (7, 11) GROUP BY u"""),
        "url_keys": """SELECT page_id, rtrim(split_part(url, '?', 1), '/') AS url_key,
            CASE WHEN regexp_matches(url, '^[^?#]*\\?([^#]*&)?id=\\d+(&|#|$)') THEN regexp_extract(url, '[?&]id=(\\d+)', 1)
              ELSE nullif(regexp_extract(url, '(\\d{6,})', 1), '') END AS listing_id FROM pages""",
        "page_frontier": """SELECT page_id, page, CASE WHEN page = 1 THEN url
            WHEN contains(url, 'pageNumber=') THEN regexp_replace(url, 'pageNumber=\\d+', 'pageNumber=' || page, 'g')
            WHEN contains(url, '?') THEN url || '&pageNumber=' || page ELSE url || '?pageNumber=' || page END AS page_url
            FROM pages, (SELECT unnest(range(1, 5)) AS page)""",
        "site_of_urls": """SELECT page_id, url, site, CASE WHEN contains(url, '://') THEN site END AS admissible, listing_id,
            CASE WHEN site = 'mobilede' OR true THEN 'https://www.mobile.de/ro/vehicule/detalii.html?id=' || listing_id END AS detail_url,
            'https://www.mobile.de/consumer/api/search/srp?dam=false&isSearchRequest=true&s=Car&vc=Car' AS api_url
            FROM (SELECT page_id, CAST(page_id + 1000000 AS VARCHAR) AS listing_id,
              'https://' || ['www.autovit.ro', 'suchen.mobile.de', 'ads.example', 'Mobile.de'][page_id % 4 + 1] || '/d/'
                || CAST(page_id + 1000000 AS VARCHAR) || '.html' AS url,
              ['autovit', 'mobilede', NULL, 'mobilede'][page_id % 4 + 1] AS site FROM pages)""",
        "slug_keys": f"SELECT doc_id, md5({_slug('text')}) AS digest FROM documents",
        "document_numbers": """SELECT doc_id,
            CAST(TRY_CAST(nullif(regexp_replace(regexp_extract(replace(text, chr(160), ' '), '\\d{1,3}(?:[.\\s]\\d{3})+|\\d+'), '[. ]', '', 'g'), '') AS BIGINT) AS VARCHAR) AS first_integer,
            CAST(TRY_CAST(nullif(regexp_replace(regexp_extract(replace(text, chr(160), ' '), '\\d[\\d.,\\s]*'), '\\D', '', 'g'), '') AS BIGINT) AS VARCHAR) AS first_digits
            FROM documents""",
        "title_cased_documents": f"""SELECT conv_id, turn, md5({_title("trim(regexp_replace(text, '\\s+', ' ', 'g'))")}) AS digest FROM conversations""",
        "synthetic_ids": _with(
            _BEST, """SELECT source_listing_key, substr(sha1(concat_ws('|', title, make, model, CAST(year AS VARCHAR),
            coalesce(CAST(nullif(mileage_km, 0) AS VARCHAR), ''), CAST(power_hp AS VARCHAR),
            coalesce(CAST(nullif(CAST(floor(original_price_value) AS BIGINT), 0) AS VARCHAR), ''), location_city)), 1, 16) AS synthetic_id
            FROM best"""),
        "power_and_engine": """
            SELECT p_partkey, power_text, engine_text, CASE WHEN hp BETWEEN 30 AND 900 THEN hp END AS power_hp,
              CASE WHEN cm3 BETWEEN 600 AND 8000 THEN cm3 END AS engine_cm3,
              CASE WHEN k IN (1, 3) AND s_hp BETWEEN 30 AND 900 THEN 'explicit_hp' WHEN k IN (1, 2) AND kw BETWEEN 30 AND 900 THEN 'kw_to_hp' END AS power_found_by,
              CASE WHEN k = 3 AND cm3 BETWEEN 600 AND 8000 THEN 'explicit_capacity' WHEN k IN (1, 4) AND cm3 BETWEEN 600 AND 8000 THEN 'title_displacement' END AS engine_found_by
            FROM (
              SELECT p_partkey, k, s, t,
                [t || ' kW (' || (s * 2) || ' PS)', t || ' kW', (s * 20) || ' hp', t][k] AS power_text,
                [l || ' TDI', l || ' l/100km ' || t, (s * 100 + 1000) || ' ccm', l || ' d'][k] AS engine_text,
                CAST(CASE WHEN s >= 10 THEN round_even(s * 1.3596216173::DOUBLE, 0) END AS BIGINT) AS kw,
                CAST(CASE k WHEN 1 THEN CASE WHEN s * 2 >= 10 THEN s * 2 END WHEN 3 THEN CASE WHEN s * 20 BETWEEN 10 AND 999 THEN s * 20 END END AS BIGINT) AS s_hp,
                CAST(CASE k WHEN 1 THEN s * 2 WHEN 2 THEN CASE WHEN s >= 10 THEN round_even(s * 1.3596216173::DOUBLE, 0) END
                  WHEN 3 THEN CASE WHEN s * 20 BETWEEN 10 AND 999 THEN s * 20 END ELSE CASE WHEN s >= 10 THEN s END END AS BIGINT) AS hp,
                CAST(CASE k WHEN 1 THEN a * 1000 + d * 100 WHEN 3 THEN s * 100 + 1000
                  WHEN 4 THEN CASE WHEN d = 0 THEN a * 1000 END END AS BIGINT) AS cm3
              FROM (SELECT p_partkey, p_partkey % 4 + 1 AS k, p_size AS s, CAST(p_size AS VARCHAR) AS t, p_partkey % 7 AS a,
                p_size % 10 AS d, CAST(p_partkey % 7 AS VARCHAR) || '.' || CAST(p_size % 10 AS VARCHAR) AS l FROM part))""",
        "price_texts": """SELECT o_orderkey, CAST(cents AS DOUBLE) / 100 AS european, CAST(cents AS DOUBLE) / 100 AS plain,
            CAST(floor(cents / 100) AS BIGINT) AS grouped FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)""",
    }


def _histogram(column: str) -> str:
    return _with(
        _FRAME, f"""SELECT bin, round(any_value(lo) + bin * any_value(w), 4) AS bin_start,
        round(any_value(lo) + (bin + 1) * any_value(w), 4) AS bin_end, count(*) AS rows FROM (
          SELECT lo, (hi - lo) / 30 AS w, least(CAST(floor((v - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS bin FROM (
            SELECT CAST({column} AS DOUBLE) AS v, CAST(min({column}) OVER () AS DOUBLE) AS lo,
              CAST(max({column}) OVER () AS DOUBLE) AS hi FROM frame WHERE {column} IS NOT NULL)) GROUP BY bin""")


def statements() -> dict[str, str]:
    from adlens import oracles_pages, oracles_streams

    merged = {**_core(), **oracles_pages.statements(), **oracles_streams.statements()}
    # averages of doubles round to another cent in a few rows
    waiting = {"holdout_table"}
    return {name: sql for name, sql in merged.items() if name not in waiting}

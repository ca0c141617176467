"""Operators against brute force and hand-computed results on small tables."""

import datetime as dt
import json
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.operators import admission, dedupe, lookup, pricing, similar
from adlens.operators.neighbours import nearest
from adlens.operators.quantiles import exact_quantiles
from adlens.operators.significance import beta_cdf, chi_square_tail
from adlens.schemas import ESTIMATE, LISTING


def _row(key, score, at, fuzzy=None):
    return {"source_listing_key": key, "dedupe_exact_key": key, "completeness_score": score, "scraped_at": at,
            "dedupe_fuzzy_key": fuzzy}


def test_best_record_rules(spark):
    from pyspark.sql import types as T

    rows = [_row("a", 5, "2024-01-02"), _row("a", 7, "2024-01-01"), _row("b", 5, "2024-01-01"), _row("b", 5, "2024-01-03"),
            _row("c", 5, None, "f"), _row("c", 5, None, "f"), _row("d", 9, None, "f"), _row("e", 1, None)]
    schema = T.StructType([*LISTING.fields, T.StructField("pos", T.IntegerType())])
    df = spark.createDataFrame([tuple(r.get(f.name) for f in LISTING.fields) + (i,) for i, r in enumerate(rows)], schema)
    exact = {r.source_listing_key: r.pos for r in dedupe.keep_best_exact(df, "pos").collect()}
    assert exact == {"a": 1, "b": 3, "c": 5, "d": 6, "e": 7}
    kept = dedupe.deduplicate(df, "pos", fuzzy=True)
    assert sorted(r.source_listing_key for r in kept.collect()) == ["a", "b", "d", "e"]
    report = dedupe.dedupe_report(kept).first()
    assert (report.loaded_rows, report.kept_rows, report.exact_duplicates_removed, report.fuzzy_duplicates_removed) == (8, 4, 3, 1)


@pytest.mark.parametrize("hot", [False, True])
def test_quantiles_equal_numpy(spark, hot):
    rng = random.Random(3)
    rows = [("g" if hot or i % 3 else "h", rng.choice([5.0, rng.random() * 100])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.01, 0.5, 0.995, 1.0]
    for r in exact_quantiles(df, ["g"], "v", probs, "q").collect():
        values = [v for g, v in rows if g == r.g]
        assert np.allclose(r.q, np.quantile(values, probs), rtol=1e-12)
    whole = exact_quantiles(df, [], "v", probs, "q").first()
    assert np.allclose(whole.q, np.quantile([v for _, v in rows], probs), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 501, 30011])
def test_quantiles_between_two_ranks(spark, n):
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    probs = [0.19939, 0.5, 0.7501]
    for groups in ([], ["g"]):
        row = exact_quantiles(df, groups, "v", probs, "q").first()
        assert np.allclose(row.q, np.quantile(np.arange(n), probs), rtol=1e-9)


def test_tail_probabilities():
    assert abs(chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(beta_cdf(0.5, 2, 2) - 0.5) < 1e-12
    assert abs(beta_cdf(0.25, 1, 3) - (1 - 0.75**3)) < 1e-12


@pytest.mark.parametrize("chunk,block", [(8192, 8192), (7, 5)])
def test_neighbours_equal_brute_force(spark, chunk, block):
    rng = random.Random(5)
    rows = [(f"k{i:03d}", "p", float(rng.randint(0, 30)) if rng.random() > 0.1 else None, rng.random() * 9,
             rng.choice(["x", "y", None])) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, pool string, a double, b double, w string")
    found = nearest(df, df, "pool", "key", "key", ["a", "b"], ["w"], 4, chunk, block).collect()
    a = np.array([np.nan if r[2] is None else r[2] for r in rows])
    a = np.where(np.isnan(a), np.nanmedian(a), a)
    b = np.array([r[3] for r in rows])
    mode = max("xy", key=lambda v: (sum(r[4] == v for r in rows), -ord(v)))
    w = [r[4] or mode for r in rows]
    z = np.stack([(a - a.mean()) / a.std(), (b - b.mean()) / b.std()], axis=1)
    wanted = {}
    for i, r in enumerate(rows):
        d2 = ((z - z[i]) ** 2).sum(axis=1) + 2.0 * np.array([x != w[i] for x in w])
        order = sorted(range(len(rows)), key=lambda j: (round(d2[j], 9), rows[j][0]))[:4]
        wanted[r[0]] = [rows[j][0] for j in order]
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.qid, []).append(r.cid)
    assert got == wanted


def _scan(times, limit, window):
    held, out = deque(), []
    for t in times:
        while held and held[0] <= t - window:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


@pytest.mark.parametrize("segment", [250_000, 20])
def test_admission_equals_scan(spark, segment):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    seconds = sorted(rng.randint(0, 3000) for _ in range(300))
    rows = [("predict", "hot", start + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)]
    rows += [("predict", "cold", start, 1000), ("other", "hot", start, 1001)]
    events = spark.createDataFrame(rows, "scope string, key string, ts timestamp, event_id bigint")
    decided = admission.admit(events, {"predict": (3, 60)}, segment).collect()
    got = {r.event_id: r.allowed for r in decided}
    assert [got[i] for i in range(300)] == _scan(seconds, 3, 60)
    assert got[1000] and got[1001] and len(got) == 302


def test_admission_case(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("predict", "7", start + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 0, 0, 60])]
    events = spark.createDataFrame(rows, "scope string, key string, ts timestamp, event_id bigint")
    decided = admission.admit(events, {"predict": (2, 60)}).orderBy("event_id")
    out = decided.select("allowed", "remaining", "retry_after_seconds", admission.decision_headers().alias("h")).collect()
    assert [tuple(r)[:3] for r in out] == [(True, 1, 0), (True, 0, 0), (False, 0, 60), (True, 1, 0)]
    assert out[2].h == {"X-RateLimit-Limit": "2", "X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "60", "Retry-After": "60"}


def test_policies():
    assert admission.policies()["register"] == (3, 3600)
    assert admission.policies({"predict": ("8", "120"), "login": ("x", "-1")})["predict"] == (8, 120)
    assert admission.policies({"login": ("x", "-1")})["login"] == (10, 900)


def test_voting_is_not_weighted(spark):
    from pyspark.sql import types as T

    def entry(model, price, mae):
        return tuple({"model": model, "predicted_price_eur": price, "mae": mae}.get(f.name) for f in ESTIMATE.fields)

    schema = T.StructType([T.StructField("model_estimates", T.ArrayType(ESTIMATE))])
    df = spark.createDataFrame(
        [([entry("ridge", 10000.0, 1000.0), entry("other", 20000.0, 1000.0), entry("voting_ensemble", 100000.0, 100.0)],)], schema
    )
    row = pricing.combine_estimates(df, "inverse_mae").first()
    assert row.predicted_price_eur == 15000
    voting = row.model_estimates[2]
    assert voting.excluded_from_weighted_average and voting.ensemble_weight is None


def test_verdict_bounds(spark):
    df = spark.createDataFrame([(84.9,), (85.0,), (114.9,), (115.0,), (None,)], "a double")
    got = [r.v for r in df.select(pricing.verdict(F.col("a"), F.lit(100.0)).alias("v")).collect()]
    assert got == ["too_low_suspicious", "fair", "fair", "too_high", "unknown"]


def test_match_quality_uses_the_short_list(spark):
    row = {"make": "BMW", "model": "X3", "fuel_type": "diesel", "transmission": "manual", "year": 2015, "mileage_km": 1000,
           "power_hp": 100, "engine_capacity_cm3": 2000}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in row.items()))
    same = {k: F.col(k) for k in row}
    other = same | {"fuel_type": F.lit("lpg"), "transmission": F.lit("x"), "year": F.lit(1990)}
    first = df.select(similar.match_quality(similar.match_reasons(same, same)), similar.match_quality(similar.match_reasons(same, other))).first()
    assert tuple(first) == ("close", "very_close")


def test_lookup_takes_tables_in_order_and_rows_by_place(spark):
    schema = "url string, listing_id string, source string, place bigint"
    a = spark.createDataFrame([("u1", "1", "A", 0), ("u2", "2", "a", 1), ("u2", "3", "b", 2), (None, None, None, 3)], schema)
    b = spark.createDataFrame([("u1", "9", "b", 0), ("u9", "8", "b", 1), ("u3/", "2", "b", 2), ("u8", "", "b", 3)], schema)
    asked = spark.createDataFrame([("u3", "3"), ("u9", "9"), ("u2?from=mail", "1"), (None, None), ("", ""), ("no", "no"), ("u9", "9")], "url string, wanted_id string")

    def found(**options):
        rows = lookup.resolve(asked, [("a", a), ("b", b)], "place", **options).collect()
        return sorted(((r.url, r.found_in, json.loads(r.listing)["place"] if r.listing else None) for r in rows), key=repr)

    # the id 3 in the first table beats the URL u3 in the second
    assert [x for x in found() if not x[1]] == [("no", None, None), (None, None, None)]
    # an empty URL fits the first row without one
    assert [x for x in found() if x[1]] == [("", "a", 3), ("u2?from=mail", "a", 1), ("u3", "a", 2), ("u9", "b", 1), ("u9", "b", 1)]
    # by place the id 1 stands before the URL u2, and the id 9 before the URL u9
    assert [x for x in found(prefer="position") if x[1]] == [("", "a", 3), ("u2?from=mail", "a", 0), ("u3", "a", 2), ("u9", "b", 0), ("u9", "b", 0)]
    # only rows of one source, in any case
    assert [x for x in found(prefer="position", source="B") if x[1]] == [("u2?from=mail", "a", 2), ("u3", "a", 2), ("u9", "b", 0), ("u9", "b", 0)]
    assert lookup.unresolved(lookup.resolve(asked, [("a", a), ("b", b)], "place")).count() == 2
    assert lookup.resolve(asked, [("a", a.limit(0))], "place").where("found_in is not null").count() == 0

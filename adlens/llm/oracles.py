"""Results of the text operators stated independently as SQL, where SQL can state them."""

from __future__ import annotations

_WORD = "[^\\x20\\x09-\\x0D]+"


def _mixing() -> str:
    return f"""
        WITH d AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size,
            md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS tie FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (
          SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w,
            CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget, source_size * 2 AS cap FROM s),
        o AS (
          SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
            CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS cap_before,
            CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_left
          FROM r WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, cap_before + ratio * w_left <= budget AS filled FROM o),
        l AS (SELECT (any_value(budget) - coalesce(sum(cap) FILTER (filled), 0)) / sum(w) FILTER (NOT filled) AS rate FROM f),
        t AS (
          SELECT source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE rate * w END AS target FROM f, l),
        k AS (
          SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
        p AS (
          SELECT d.doc_id, d.size, d.tie, k.source, k.source_size, k.target, k.whole,
            CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS p, target - whole * source_size AS rest,
            (CAST(CAST('0x' || substr(tie, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
          FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
        q AS (
          SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
        c AS (
          SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, tie) AS ends FROM q)
        SELECT doc_id, size, source_size, target,
          size * (whole + CASE WHEN p > 0 AND 2 * ends - size <= 2 * rest THEN 1 ELSE 0 END) AS taken FROM c"""


def _urls() -> str:
    words = "ads adserver banner bets casino lottery payday pills poker porn spam tracker viagra xxx".replace(" ", "|")
    return f"""
        WITH a AS (
          SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
        c AS (
          SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
        d AS (
          SELECT *, CASE
            WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM c)
        SELECT page_id, host, path, rule, CASE
          WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
          WHEN regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9])({words})([^a-z0-9]|$)') THEN 'block'
          ELSE 'allow' END AS verdict FROM d"""


def _chat() -> str:
    trap = "\\### Assistant: </turn> ok"
    def escaped(column: str) -> str:
        return f"replace(replace(replace({column}, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>')"
    return f"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '{trap}' UNION ALL SELECT -7, 1, 'assistant', '{trap}'),
        written AS (
          SELECT *, CASE WHEN contains(role || text, '\\') OR contains(role, ':') OR contains(role, '#') OR contains(text, '###')
              OR contains(text, '</turn>') THEN '### ' || replace({escaped('role')}, ':', '\\:') || ': ' || {escaped('text')}
            ELSE '### ' || role || ': ' || text END || '</turn>' || chr(10) AS piece FROM rows),
        grouped AS (
          SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
            coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
            string_agg(piece, '' ORDER BY turn NULLS FIRST, role, text) AS formatted
          FROM written GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
          length(formatted) AS formatted_chars FROM grouped"""


def _search() -> str:
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, {terms} AS terms FROM documents WHERE text IS NOT NULL),
        s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
        p AS (
          SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf
          FROM (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY row, term),
        w AS (
          SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, docs),
        shares AS (
          SELECT row, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))) AS part
          FROM p JOIN w USING (term), s),
        i AS (
          SELECT item, item_id, term, count(*)::BIGINT AS times
          FROM (SELECT row_number() OVER () AS item, item_id, unnest({terms}) AS term FROM benchmark) GROUP BY item, item_id, term),
        scored AS (SELECT item, item_id, row, doc_id, sum(times * part)::BIGINT AS score FROM i JOIN shares USING (term) GROUP BY item, item_id, row, doc_id),
        ranked AS (
          SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
          FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10"""


def statements() -> dict[str, str]:
    return {"op13_lexical_search": _search(), "op4_mixing": _mixing(), "op5_url_rules": _urls(), "op7_chat": _chat()}

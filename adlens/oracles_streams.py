"""SQL for the event jobs: a recursive walk over the events of each key."""

from __future__ import annotations

_WALK = """
WITH RECURSIVE ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT event_id, key, n, true AS allowed, [t] AS held, CAST(1 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS retry
  FROM ev WHERE n = 1
  UNION ALL
  SELECT event_id, key, n, ok, CASE WHEN ok THEN list_append(live, t) ELSE live END,
    CASE WHEN ok THEN 1 - CAST(len(live) AS BIGINT) ELSE 0 END,
    CASE WHEN ok THEN 0 ELSE greatest(1, CAST(ceil((86400000000 - (t - live[1])) / 1000000.0) AS BIGINT)) END
  FROM (SELECT e.event_id, e.key, e.n, e.t, list_filter(w.held, lambda x: x > e.t - 86400000000) AS live,
      len(list_filter(w.held, lambda x: x > e.t - 86400000000)) < 2 AS ok
    FROM walk w JOIN ev e ON e.key = w.key AND e.n = w.n + 1))
"""


def statements() -> dict[str, str]:
    decisions = _WALK + "SELECT event_id, key, allowed, remaining, retry AS retry_after_seconds FROM walk"
    return {
        "rate_decisions": decisions,
        "rate_decisions_stream": decisions,
        "rate_decisions_late_stream": decisions,
        "first_deliveries_stream": "SELECT event_id, user_id, event_type, value FROM events",
        "rate_decisions_disabled": """SELECT event_id, CAST(user_id AS VARCHAR) AS key, true AS allowed,
            CAST(0 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS retry_after_seconds FROM events""",
        "rate_headers": _WALK + """SELECT event_id, '2' AS limit_header, CAST(remaining AS VARCHAR) AS remaining_header,
            CASE WHEN NOT allowed THEN CAST(retry AS VARCHAR) END AS retry_header FROM walk""",
        "client_addresses": """SELECT event_id,
            CASE WHEN event_id % 3 = 0 THEN '203.0.113.' ELSE '198.51.100.' END || CAST(user_id % 250 AS VARCHAR) AS trusted,
            CASE WHEN event_id % 2 = 0 THEN '127.0.0.1' ELSE 'unknown' END AS direct FROM events""",
    }

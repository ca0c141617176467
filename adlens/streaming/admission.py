"""The same admission over a live stream, with one state per (scope, key).

An event is decided once the watermark has passed it: then nothing earlier can come any
more, so events that arrive late (within the watermark) are decided in their place, as in
a batch. Until then its time and id wait in the state of the key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from adlens.operators.admission import MICROS, _policy_columns, policies, scan

_OUTPUT = (
    "scope string, key string, t bigint, event_id bigint, limit bigint, allowed boolean, "
    "remaining bigint, retry_after_seconds bigint"
)
#: admitted times of the window, waiting events, and the policy
_STATE = "held array<bigint>, times array<bigint>, ids array<bigint>, limit bigint, seconds bigint"


def _per_key(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, times, ids, limit, seconds = state.get if state.exists else ([], [], [], 0, 0)
    waiting = [(np.array(times, dtype=np.int64), np.array(ids, dtype=np.int64))]
    for rows in batches:
        if len(rows):
            limit, seconds = int(rows["limit"].iloc[0]), int(rows["window_seconds"].iloc[0])
            waiting.append((rows["t"].to_numpy(), rows["event_id"].to_numpy()))
    times, ids = (np.concatenate(part) for part in zip(*waiting))
    order = np.lexsort((ids, times))
    times, ids = times[order], ids[order]

    limited = limit > 0 and seconds > 0
    passed = state.getCurrentWatermarkMs() * 1000
    # without a limit the order does not matter
    n = int(np.searchsorted(times, passed, side="right")) if limited else len(times)
    held = deque(held)
    if limited:
        allowed, remaining, retry = scan(times[:n], limit, seconds * MICROS, held)
        while held and held[0] <= passed - seconds * MICROS:
            held.popleft()
    else:
        held.clear()
        allowed, remaining, retry = True, max(limit, 0), 0

    if n < len(times) or held:
        state.update((list(held), times[n:].tolist(), ids[n:].tolist(), limit, seconds))
        # the next event to decide, or the end of the window, after which an idle key goes
        wake = int(times[n]) if n < len(times) else held[-1] + seconds * MICROS
        state.setTimeoutTimestamp(max(-(-wake // 1000), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if n:
        yield pd.DataFrame({
            "scope": key[0], "key": key[1], "t": times[:n], "event_id": ids[:n], "limit": limit,
            "allowed": allowed, "remaining": remaining, "retry_after_seconds": retry,
        })


def admit_stream(
    events: DataFrame, table: dict[str, tuple[int, int]] | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """Decisions for a stream of events (scope, key, ts, event_id), in event time.

    A decision appears when the watermark has passed its event, ``lateness`` behind the
    newest one; a stream that ends needs a later event to bring out its last decisions.
    Events later than the watermark are dropped and counted in the query's
    ``numRowsDroppedByWatermark``. The state of a key holds its events of that time and of
    the micro-batch, which the rate limit of the source bounds.
    """
    marked = _policy_columns(
        events.withWatermark("ts", lateness).select(
            "scope", F.col("key").cast("string").alias("key"), "ts",
            F.unix_micros("ts").alias("t"), F.col("event_id").cast("bigint").alias("event_id"),
        ),
        table or policies(),
    )
    decided = marked.groupBy("scope", "key").applyInPandasWithState(
        _per_key, _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return decided.select(
        "scope", "key", F.timestamp_micros("t").alias("ts"), "event_id", "limit", "allowed", "remaining", "retry_after_seconds"
    )

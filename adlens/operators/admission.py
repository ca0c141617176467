"""Sliding-window admission: at most ``limit`` admitted events per key and window.

A rejected event does not count, so a decision depends on all earlier decisions of its
key. Within a key the work is a scan in time order that holds at most ``limit`` time
stamps. A key with many events is cut into time segments at least one window long. All
segments run at once, first as if nothing had been admitted before; a segment whose
predecessor turns out to hand over something else runs again until nothing changes. The
result equals the scan over the whole key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.session import cut_lineage

SEGMENT_EVENTS = 250_000
MICROS = 1_000_000


# --- policies ---------------------------------------------------------------------------


def _whole(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def policies(overrides: dict[str, tuple[str | None, str | None]] | None = None) -> dict[str, tuple[int, int]]:
    """Scope to (limit, window seconds). Overrides are texts; unusable ones keep the default."""
    chosen = {}
    for scope, (limit, window) in fv.DEFAULT_POLICIES.items():
        wanted = (overrides or {}).get(scope, (None, None))
        new_limit, new_window = _whole(wanted[0]), _whole(wanted[1])
        chosen[scope] = (
            limit if new_limit is None else max(new_limit, 0),
            window if new_window is None or new_window <= 0 else new_window,
        )
    return chosen


def _policy_columns(events: DataFrame, table: dict[str, tuple[int, int]]) -> DataFrame:
    """Limit and window by scope; a scope without a policy is not limited."""
    rows = [(s, int(a), int(b)) for s, (a, b) in table.items()]
    small = events.sparkSession.createDataFrame(rows, "scope string, limit bigint, window_seconds bigint")
    joined = events.join(F.broadcast(small), "scope", "left")
    return joined.fillna(0, subset=["limit", "window_seconds"])


def is_limited() -> Column:
    return (F.col("limit") > 0) & (F.col("window_seconds") > 0)


# --- the scan ----------------------------------------------------------------------------


def scan(times: np.ndarray, limit: int, window: int, held: deque) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decide events in time order (microseconds); ``held`` is changed in place.

    While the window is full every event up to the next free moment is rejected in one
    step, so the work grows with the admitted events, not with all of them.
    """
    n = len(times)
    allowed = np.zeros(n, dtype=bool)
    remaining = np.zeros(n, dtype=np.int64)
    retry = np.zeros(n, dtype=np.int64)
    i = 0
    while i < n:
        now = int(times[i])
        while held and held[0] <= now - window:
            held.popleft()
        if len(held) < limit:
            held.append(now)
            allowed[i] = True
            remaining[i] = limit - len(held)
            i += 1
            continue
        free = held[0] + window
        j = i + max(1, int(np.searchsorted(times[i:], free, side="left")))
        left = window - (times[i:j] - held[0])
        retry[i:j] = np.maximum(1, -(-left // MICROS))
        i = j
    return allowed, remaining, retry


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a group arrive sorted by time; anything else would give wrong decisions."""
    last = None
    for batch in batches:
        times = batch["t"].to_numpy()
        if len(times) and ((last is not None and times[0] < last) or np.any(np.diff(times) < 0)):
            raise ValueError("events of a group arrived out of order")
        if len(times):
            last = times[-1]
        yield batch


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: deque = deque()
    for batch in _in_order(batches):
        carried = batch["held"].notna().to_numpy()
        for stamps in batch.loc[carried, "held"]:
            held.extend(int(s) for s in stamps)
        rows = batch[~carried]
        if rows.empty:
            continue
        allowed, remaining, retry = scan(
            rows["t"].to_numpy(), int(rows["limit"].iloc[0]), int(rows["window_seconds"].iloc[0]) * MICROS, held
        )
        yield rows[["scope", "key", "t", "event_id", "limit"]].assign(
            allowed=allowed, remaining=remaining, retry_after_seconds=retry
        )


def _end_state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: deque = deque()
    last = None
    for batch in _in_order(batches):
        carried = batch["held"].notna().to_numpy()
        for stamps in batch.loc[carried, "held"]:
            held.extend(int(s) for s in stamps)
        rows = batch[~carried]
        if rows.empty:
            continue
        last = rows.iloc[-1]
        scan(rows["t"].to_numpy(), int(last["limit"]), int(last["window_seconds"]) * MICROS, held)
    if last is not None:
        yield pd.DataFrame(
            {"scope": [last["scope"]], "key": [last["key"]], "segment": [last["segment"]], "held": [list(held)]}
        )


_GROUP = ["scope", "key", "segment"]
_DECISION = "scope string, key string, t bigint, event_id bigint, limit bigint, allowed boolean, remaining bigint, retry_after_seconds bigint"


def _grouped(events: DataFrame, carried: DataFrame | None):
    """Groups in time order, each led by the time stamps its predecessor hands over."""
    rows = events.withColumn("held", F.lit(None).cast("array<bigint>"))
    if carried is not None:
        lead = carried.where(F.size("held") > 0).select(
            *_GROUP, F.element_at("held", 1).alias("t"), F.lit(None).cast("bigint").alias("event_id"),
            F.lit(None).cast("bigint").alias("limit"), F.lit(None).cast("bigint").alias("window_seconds"), "held",
        )
        rows = rows.select(*_GROUP, "t", "event_id", "limit", "window_seconds", "held").unionByName(lead)
    ordered = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "t", F.asc_nulls_first("event_id"))
    return ordered.groupBy(*_GROUP)


def _hand_over(states: DataFrame) -> DataFrame:
    """What each segment receives: the state its predecessor ends with."""
    by = W.partitionBy("scope", "key").orderBy("segment")
    before = F.lag("held").over(by)
    return states.withColumn("received", F.coalesce(before, F.array().cast("array<bigint>")))


def admit(
    events: DataFrame, table: dict[str, tuple[int, int]] | None = None, segment_events: int = SEGMENT_EVENTS
) -> DataFrame:
    """Decisions for events (scope, key, ts, event_id); event ids order events of one instant."""
    marked = _policy_columns(
        events.select(
            "scope", F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("t"),
            F.col("event_id").cast("bigint").alias("event_id"),
        ),
        table or policies(),
    )
    free = marked.where(~is_limited()).select(
        "scope", "key", "t", "event_id", "limit", F.lit(True).alias("allowed"),
        F.greatest("limit", F.lit(0)).cast("bigint").alias("remaining"),
        F.lit(0).cast("bigint").alias("retry_after_seconds"),
    )
    limited = marked.where(is_limited())
    spans = limited.groupBy("scope", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.max("window_seconds").alias("w"),
    ).withColumn("pieces", F.ceil(F.col("n") / F.lit(segment_events)))
    width = F.greatest(F.col("w") * MICROS, F.ceil((F.col("t1") - F.col("t0") + 1) / F.col("pieces")))
    spans = spans.select("scope", "key", "t0", width.cast("bigint").alias("width"), "pieces")
    busiest = spans.agg(F.max("pieces").alias("m")).first().m or 1

    if busiest <= 1:
        segmented = limited.withColumn("segment", F.lit(0).cast("bigint"))
        carried = None
    else:
        segmented = limited.join(spans, ["scope", "key"]).withColumn(
            "segment",
            F.when(F.col("pieces") > 1, F.floor((F.col("t") - F.col("t0")) / F.col("width"))).otherwise(F.lit(0)).cast("bigint"),
        )
        carried = _settle(segmented.where(F.col("pieces") > 1).drop("t0", "width", "pieces"))
        segmented = segmented.drop("t0", "width", "pieces")
    decided = _grouped(segmented, carried).applyInPandas(_decide_group, _DECISION)
    return decided.unionByName(free).withColumn("ts", F.timestamp_micros("t")).drop("t")


def _decide_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _decide(batches)


def _end_state_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _end_state(batches)


def _settle(events: DataFrame) -> DataFrame:
    """Received time stamps per segment, run to the point where nothing changes."""
    schema = "scope string, key string, segment bigint, held array<bigint>"
    none = F.array().cast("array<bigint>")
    states = cut_lineage(
        _grouped(events, None).applyInPandas(_end_state_group, schema).withColumn("used", none)
    )
    while True:
        linked = _hand_over(states)
        stale = linked.where(F.col("received") != F.col("used")).select(*_GROUP, F.col("received").alias("held"))
        if stale.isEmpty():
            return linked.select(*_GROUP, F.col("received").alias("held"))
        again = events.join(stale.select(*_GROUP), _GROUP, "left_semi")
        rerun = _grouped(again, stale).applyInPandas(_end_state_group, schema)
        fresh = rerun.select(*_GROUP, F.col("held").alias("new_held"))
        states = cut_lineage(
            linked.join(fresh, _GROUP, "left").select(
                *_GROUP, F.coalesce("new_held", "held").alias("held"), F.col("received").alias("used")
            )
        )


def decision_headers(prefix: str = "X-RateLimit") -> Column:
    """Response headers of a decision as a map."""
    limit, remaining = F.col("limit").cast("string"), F.col("remaining").cast("string")
    retry = F.col("retry_after_seconds").cast("string")
    basic = [F.lit(f"{prefix}-Limit"), limit, F.lit(f"{prefix}-Remaining"), remaining]
    full = [*basic, F.lit(f"{prefix}-Reset"), retry, F.lit("Retry-After"), retry]
    return F.when(F.col("allowed"), F.create_map(*basic)).otherwise(F.create_map(*full))

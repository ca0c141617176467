"""Exact quantiles per group without gathering a group in one task.

A sketch brackets every wanted quantile, then one counting pass settles it exactly:
values outside the brackets collapse to a handful of counters on the map side, so only
about one value in a thousand is ordered, whatever the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10000
MARGIN = 4.0 / ACCURACY
SMALL_GROUP = 2 * ACCURACY


def _brackets(probs: list[float]) -> list[float]:
    return [min(1.0, max(0.0, p + side)) for p in probs for side in (-MARGIN, MARGIN)]


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, probs: list[float], name: str = "quantiles", few_groups: bool = False
) -> DataFrame:
    """``groups``, ``n`` and an array with one linearly interpolated quantile per entry of ``probs``.

    NULL values are left out; groups without a value do not appear. ``few_groups`` says that the number of groups
    has a fixed bound; their brackets then go to the rows, and no row is moved by its group.
    """
    data = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    sketch = data.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("_v", _brackets(probs), ACCURACY).alias("_edges"),
    )
    if groups:
        brackets = sketch.select(*groups, "_edges", F.col("n").alias("_rows"))
        marked = data.join(F.broadcast(brackets) if few_groups else brackets, groups)
        edge = lambda i: F.col("_edges")[i]
        # the margin must span a few ranks, which it does only in groups of some size
        few = F.col("_rows") <= SMALL_GROUP
    else:
        # one row: two numbers per quantile
        known = sketch.first()
        edges = known._edges or [0.0] * (2 * len(probs))
        marked = data
        few = F.lit(known.n <= SMALL_GROUP)
        edge = lambda i: F.lit(float(edges[i]))

    v = F.col("_v")
    inside = few
    for i in range(len(probs)):
        inside = inside | v.between(edge(2 * i), edge(2 * i + 1))
    # the highest bracket end below the value; NULLs do not count
    below = F.greatest(
        F.lit(float("-inf")), F.lit(None).cast("double"), *[F.when(edge(2 * i + 1) < v, edge(2 * i + 1)) for i in range(len(probs))]
    )
    counted = (
        marked.select(
            *groups,
            F.when(inside, v).otherwise(below).alias("_v"),
            (~inside).cast("int").alias("_gap"),
        )
        .groupBy(*groups, "_v", "_gap")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # one row per bracketed value or gap; (value, gap) sorts a gap right behind the
    # bracket it follows
    order = W.partitionBy(*groups).orderBy("_v", "_gap")
    placed = counted.withColumns(
        {
            "_end": F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "_n": F.sum("_c").over(W.partitionBy(*groups)),
        }
    )

    def at(rank: Column) -> Column:
        here = (F.col("_gap") == 0) & (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c"))
        return F.max(F.when(here, F.col("_v")))

    picks = {}
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        picks[f"_lo{i}"] = at(F.floor(place))
        picks[f"_hi{i}"] = at(F.ceil(place))
    settled = placed.groupBy(*groups).agg(
        F.max("_n").alias("n"), *[expr.alias(alias) for alias, expr in picks.items()]
    )
    quantiles = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        value_at = low + (high - low) * (place - F.floor(place))
        # the sketch keeps its error bound, so this is never reached; it must not pass silently
        quantiles.append(
            F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("quantile left its bracket")).cast("double"))
            .otherwise(value_at)
        )
    result = settled.select(*groups, "n", F.array(*quantiles).alias(name))
    return result if groups else result.where(F.col("n").isNotNull())


def exact_median(df: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    found = exact_quantiles(df, groups, value, [0.5], "_q")
    return found.select(*groups, "n", F.col("_q")[0].alias(name))


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Edges of equal-frequency bins over a whole table: quantiles without repeats."""
    row = exact_quantiles(df, [], value, [i / bins for i in range(bins + 1)], "q").first()
    return sorted(set(row.q)) if row is not None else []


def bin_number(value: Column, edges: Column) -> Column:
    """Right-closed bin of a value between ascending edges, 0 for the first; NULL outside."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    above = F.size(F.filter(inner, lambda e: value > e))
    in_range = value.between(F.get(edges, F.lit(0)), F.element_at(edges, -1))
    return F.when(in_range & (F.size(edges) > 1), above)


def equal_frequency_edges(quantiles: Column) -> Column:
    """Edges of equal-frequency bins: quantiles without repeats."""
    return F.array_distinct(quantiles)

"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for every node that has a link.

    Alternating large and small stars: each round is a few joins and grouped minima on
    links, the number of rounds grows with the logarithm of the longest path. A hub is
    one key of a join between a skewed and a unique side, which adaptive execution
    splits. NULL ends and links from a node to itself are left out; repeated links are
    harmless; no links give no rows.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = cut_lineage(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())

    def state(df: DataFrame):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = state(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        was, now = now, state(edges)
        if was == now:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())

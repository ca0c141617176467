"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A document is taken a whole number of times
for certain; for the rest of the target a sample is drawn: with ``p`` the share of the
source that is still wanted and ``u`` a random number of the document, documents are
ranked by ``(u / (1 - u)) / (p / (1 - p))``, and the first ones are taken until the words
reach the rest. ``p`` differs between sources, and ``preference`` multiplies a document's inclusion odds, so
the probabilities are unequal while the number of words is fixed.

The cut in a source's ranking is found with two rounds of counts over slots of the rank,
then exactly within one slot of a slot; no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlens.llm.common import word_count
from adlens.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SLOTS = 4096
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row per source.

    Sources by code point (NULL last) have the weights in turn and share ``share`` times
    all words; a target stops at ``most`` times the source, and what is over goes to the
    others by weight until none is above. Sources are capped in the order of their cap per
    weight, so running sums over the sources (one row each) tell which ones are.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    ranked = sizes.select(
        "source",
        "source_size",
        F.get(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(every) - 1) % len(weights))).alias("w"),
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("budget"),
    ).withColumn("cap", F.col("source_size") * most)
    ratio = F.col("cap") / F.col("w")
    before = W.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    placed = ranked.select(
        "*",
        ratio.alias("ratio"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    capped = placed.withColumn("full", F.col("cap_before") + F.col("ratio") * F.col("w_left") <= F.col("budget"))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    rate = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))) / open_w
    return capped.withColumn("rate", rate).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("rate") * F.col("w")).alias("target"),
    )


def _unit(key: Column) -> Column:
    """A number between 0 and 1 (both excluded) that depends on the key only."""
    digits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 52))


def _cut(rows: DataFrame, slot: str) -> DataFrame:
    """Per source the slot in which the ranking reaches the wanted words, and the words before it."""
    counts = rows.groupBy("source", "rest", slot).agg(F.sum("size").alias("words"))
    order = W.partitionBy("source").orderBy(slot)
    ends = counts.withColumn("end", F.sum("words").over(order)).withColumn("start", F.col("end") - F.col("words"))
    return ends.where("end > rest and start <= rest").groupBy("source").agg(F.min(F.struct(slot, "start")).alias("_at")).select(
        "source", F.col(f"_at.{slot}").alias(slot), F.col("_at.start").alias("start")
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: str = SEED,
    preference: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of every row.

    ``size`` counts words (NULL text: 0). ``copies`` is how often the mix takes the row
    and ``taken`` the words of that. A source's taken words miss its target by half a
    document at most. Same rows, seed and weights give the same mix. NULL sources are
    one source; a NULL id draws its number from the text. Rows with equal id and text
    share one number, so they are taken together or not at all. An empty table gives an
    empty table. ``keep`` names columns of ``docs`` to carry along; a name that clashes
    with a column made here is left out of them.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    carried = [c for c in keep or [] if c.lower() not in {*(m.lower() for m in made), id_col.lower()}]
    carried = list(dict.fromkeys(carried))
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    marked = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(carried)],
        word_count(F.col(text_col)).alias("size"),
        _unit(key).alias("u"),
        F.md5(key).alias("tie"),
        (F.lit(1.0) if preference is None else preference.cast("double")).alias("odds"),
    )
    small = cut_lineage(marked.drop(*[f"kept_{i}" for i in range(len(carried))]))
    sizes = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = F.col("target") / F.col("source_size")
    targets = cut_lineage(
        source_targets(sizes, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(per)).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("p", F.when(F.col("source_size") > 0, per - F.col("whole")).otherwise(F.lit(0.0)))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )

    def ranked(rows: DataFrame) -> DataFrame:
        t = targets.withColumnRenamed("source", "_source")
        joined = rows.join(t, rows["source"].eqNullSafe(t["_source"])).drop("_source")
        q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")) * F.col("odds"))
        # rank between 0 and 1 with the order of q; nothing is wanted where p is 0
        rank = F.when((F.col("p") > 0) & (F.col("odds") > 0), q / (1 + q)).otherwise(F.lit(1.0))
        slot = lambda n: F.least(F.floor(F.col("rank") * n), F.lit(n - 1)).cast("bigint")
        return joined.withColumn("rank", rank).withColumn("slot", slot(SLOTS)).withColumn("fine", slot(SLOTS * SLOTS))

    draws = ranked(small).where("p > 0")
    first = _cut(draws, "slot")
    inner = draws.join(first.withColumnRenamed("source", "_s").withColumnRenamed("slot", "_k"),
                       F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_k"))).withColumn("rest", F.col("rest") - F.col("start")).drop("_s", "_k", "start")
    inner = cut_lineage(inner.select("source", "rest", "slot", "fine", "rank", "tie", "size"))
    second = _cut(inner, "fine")
    last = inner.join(second.withColumnRenamed("source", "_s").withColumnRenamed("fine", "_k"),
                      F.col("source").eqNullSafe(F.col("_s")) & (F.col("fine") == F.col("_k")))
    units = last.groupBy("source", "rank", "tie").agg(F.sum("size").alias("size"), F.first(F.col("rest") - F.col("start")).alias("rest"))
    running = F.sum("size").over(W.partitionBy("source").orderBy("rank", "tie"))
    inside = units.withColumn("end", running).where(2 * F.col("end") - F.col("size") <= 2 * F.col("rest"))
    third = inside.groupBy("source").agg(F.max(F.struct("rank", "tie")).alias("cut"))
    f, s, t = (x.withColumnRenamed("source", "_source") for x in (first, second, third))
    cuts = targets.join(f.select("_source", F.col("slot").alias("cut_slot")), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    cuts = cuts.join(s.select("_source", F.col("fine").alias("cut_fine")), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    cuts = cuts.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    cuts = cut_lineage(cuts.select("source", "cut_slot", "cut_fine", "cut"))
    c = cuts.withColumnRenamed("source", "_source")
    rows = ranked(marked if carried else small)
    rows = rows.join(c, rows["source"].eqNullSafe(c["_source"])).drop("_source")
    more = (
        F.when(F.col("p") <= 0, False)
        .when(F.col("cut_slot").isNull() | (F.col("slot") < F.col("cut_slot")), True)
        .when(F.col("slot") > F.col("cut_slot"), False)
        .when(F.col("cut_fine").isNull() | (F.col("fine") < F.col("cut_fine")), True)
        .when(F.col("fine") > F.col("cut_fine"), False)
        .otherwise(F.coalesce(F.struct("rank", "tie") <= F.col("cut"), F.lit(False)))
    )
    copies = (F.col("whole") + more.cast("bigint")).alias("copies")
    out = rows.select("id", "source", "size", "source_size", "target", copies, *[f"kept_{i}" for i in range(len(carried))])
    return out.select(
        F.col("id").alias(id_col), *[F.col(f"kept_{i}").alias(name) for i, name in enumerate(carried)],
        "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )

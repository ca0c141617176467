"""Quality scores learnt from pairs of documents (Bradley-Terry).

A pair is a good and a bad document; the better one wins with probability
``sigmoid(score(x) - score(y))``. The score is linear in binned text statistics, so the
logistic loss on differences of features is a regression without an intercept. The limit
between accepted and rejected is the quantile of the scores at the share of bad documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm import statistics as st
from adlens.llm.common import fresh
from adlens.session import cut_lineage

BINS = 16
#: pairs that are learnt from at least, and rows of the rarer kind in a slot: the pairs grow with the labelled rows
PAIRS = 100_000
IN_SLOT = 2
ROUNDS = 4
LIMIT = 0.7
RIDGE = 1e-3
HELD_OUT = 2


@dataclass(frozen=True)
class Ranker:
    """A weight per feature and bin, and the raw score that stands for LIMIT."""

    edges: dict[str, list[float]]
    weights: dict[str, list[float]]
    limit: float

    def raw(self) -> Column:
        out = F.lit(0.0)
        for name, weights in self.weights.items():
            table = F.array(*[F.lit(float(w)) for w in weights])
            out = out + F.get(table, st.bin_of(name, self.edges[name]))
        return out

    def score(self) -> Column:
        """0 to 1, LIMIT at the raw score that stands for it."""
        shift = math.log(LIMIT / (1 - LIMIT)) - self.limit
        return 1 / (1 + F.exp(-(self.raw() + shift)))


def _pairs(labelled: DataFrame, sizes: list[int], good: int, bad: int) -> DataFrame:
    """Pairs of a good and a bad row that fall in one slot by hash, several times: PAIRS of them, or more so that
    every labelled row meets about ROUNDS * IN_SLOT others. ``x`` has the bin of each feature, ``sizes`` their numbers."""
    slots = max(1, min(math.ceil(good * bad * ROUNDS / PAIRS), min(good, bad) // IN_SLOT))
    spread = labelled.select("id", "good", "x", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))).alias("round"))
    spread = spread.withColumn("slot", F.pmod(F.xxhash64("id", "round"), F.lit(slots)))
    winner = spread.where("good").select("round", "slot", F.col("x").alias("a"), F.col("id").alias("i"))
    loser = spread.where("not good").select("round", "slot", F.col("x").alias("b"), F.col("id").alias("j"))
    pairs = winner.join(loser, ["round", "slot"])
    turned = F.pmod(F.xxhash64("i", "j"), F.lit(2)) == 1
    first, second = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    laid = pairs.select(first.alias("a"), second.alias("b"), F.when(turned, 0.0).otherwise(1.0).alias("label"))
    hot = lambda side, n, k: (F.get(side, F.lit(n)) == k).cast("double")
    gap = F.array(*[hot("a", n, k) - hot("b", n, k) for n, size in enumerate(sizes) for k in range(size)])
    return laid.select(array_to_vector(gap).alias("features"), "label")


def learn(labelled: DataFrame, names: list[str]) -> Ranker:
    """Ranker from ``id``, ``good`` and the features. One class or no rows: all weights are 0."""
    rows = cut_lineage(labelled.select("id", "good", *names))
    edges = st.quantile_edges(rows, names, BINS)
    count = rows.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    good, bad = count[0], count[1]
    sizes = {n: len(edges[n]) + 1 for n in names}
    if not good or not bad:
        return Ranker(edges, {n: [0.0] * sizes[n] for n in names}, 0.0)
    bins = F.array(*[st.bin_of(n, edges[n]) for n in names])
    pairs = cut_lineage(_pairs(rows.select("id", "good", bins.alias("x")), [sizes[n] for n in names], good, bad))
    fitted = LogisticRegression(fitIntercept=False, regParam=RIDGE, maxIter=60, standardization=False).fit(pairs)
    flat = [float(x) for x in fitted.coefficients.toArray()]
    weights, at = {}, 0
    for n in names:
        weights[n] = flat[at : at + sizes[n]]
        at += sizes[n]
    ranker = Ranker(edges, weights, 0.0)
    limit = rows.agg(F.percentile(ranker.raw(), F.lit(bad / (good + bad)))).first()[0]
    return Ranker(edges, weights, float(limit))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id``, ``hash``, ``held_out`` and ``score`` of every row."""
    counted = cut_lineage(st.with_counts(docs, id_col, text_col))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    named = counted.select("id", "hash", held.alias("held_out"), *[c.alias(n) for n, c in st.features().items()])
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")).where("label is not null")
    learnt = named.where("not held_out").join(marks, "id").withColumn("good", F.col("label") == 1)
    ranker = learn(learnt, st.FEATURES)
    return named.select("id", "hash", "held_out", ranker.score().alias("score"))


def rank_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every row.

    ``held_out`` rows (crc32 of the id as text, modulo 4, is 2) are never learnt from. Several
    labels of an id count as their lowest, NULL labels are left out. A NULL or empty
    text is scored like any other, by its counts of 0. A NULL id is neither held out nor
    learnt from. Repeated rows stay repeated; other columns are not looked at. Without
    labels of both kinds every row has the score LIMIT. An empty table gives an empty table.
    """
    scored = _scored(docs, labels, id_col, text_col, label_col)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= LIMIT).cast("int").alias("predicted")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` with a score of LIMIT or more, with all their columns."""
    good = _scored(docs, labels, id_col, text_col, label_col).where(F.col("score") >= LIMIT)
    i, h = fresh(docs, "scored_id", "scored_hash")
    marks = good.select(F.col("id").alias(i), F.col("hash").alias(h)).distinct()
    return docs.join(marks, docs[id_col].eqNullSafe(marks[i]) & (F.xxhash64(docs[text_col]) == marks[h]), "left_semi")

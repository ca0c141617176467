"""Quality rules learnt as a decision list.

Sequential covering: a rule is a conjunction of thresholds on text statistics. It grows
by the condition with the highest information gain, is cut back on rows that growing did
not see, and is kept if it is precise there; the rows it covers are then left out and
the next rule is learnt. Every step is one grouped count over binned statistics, so the
driver sees a few hundred numbers. The list becomes one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm import statistics as st
from adlens.session import cut_lineage

EDGES = 64
MAX_RULES = 12
MAX_CONDITIONS = 4
PRECISION = 0.9
LEAST_ROWS = 5
#: labelled rows that are learnt from
MAX_LABELLED = 200_000


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    edge: float

    def column(self) -> Column:
        return F.col(self.feature) > self.edge if self.above else F.col(self.feature) <= self.edge

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.edge:.4g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _best(rows: DataFrame, edges: dict[str, list[float]]) -> tuple[float, Condition | None, int]:
    """The condition with the highest gain over the growing rows, and the good rows it leaves in."""
    long = rows.where("not late").select(
        "bad", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"bin_{n}").alias("b")) for n in edges])).alias("x")
    )
    counts: dict[str, dict[int, list[int]]] = {n: {} for n in edges}
    for f, b, bad, n in long.groupBy("x.f", "x.b", "bad").count().collect():
        counts[f].setdefault(b, [0, 0])[0 if bad else 1] += n
    best, chosen, left = 0.0, None, 0
    for name in sorted(edges):
        p0 = sum(c[0] for c in counts[name].values())
        n0 = sum(c[1] for c in counts[name].values())
        if not p0:
            continue
        p, n = 0, 0
        for k, edge in enumerate(edges[name]):
            here = counts[name].get(k, (0, 0))
            p, n = p + here[0], n + here[1]
            for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(p0, n0, p1, n1)
                if gain > best + 1e-9:
                    best, chosen, left = gain, Condition(name, above, edge), n1
    return best, chosen, left


def learn(labelled: DataFrame, names: list[str], bad: Column, key: str) -> list[list[Condition]]:
    """Rules for bad rows, in order. No rows, or rows of one class only, give no rules."""
    rows = st.bounded(labelled.where(bad.isNotNull()).withColumn("bad", bad), key, MAX_LABELLED)
    rows = cut_lineage(rows.select(key, "bad", *names))
    edges = st.quantile_edges(rows, names, EDGES)
    late = F.pmod(F.xxhash64(key, F.lit("late")), F.lit(3)) == 0
    left = cut_lineage(rows.select(
        "*", *[st.bin_of(n, edges[n]).alias(f"bin_{n}") for n in names], F.coalesce(late, F.lit(False)).alias("late")
    ))
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        grown: list[Condition] = []
        while len(grown) < MAX_CONDITIONS:
            gain, condition, good_left = _best(left.where(_all(grown)), edges)
            if condition is None or condition in grown:
                break
            grown.append(condition)
            if good_left == 0:
                break
        if not grown:
            break
        cuts = range(1, len(grown) + 1)
        seen = left.where("late").agg(
            *[F.count_if(_all(grown[:k]) & F.col("bad")).alias(f"p{k}") for k in cuts],
            *[F.count_if(_all(grown[:k]) & ~F.col("bad")).alias(f"n{k}") for k in cuts],
        ).first()
        worth = {k: (seen[f"p{k}"] - seen[f"n{k}"]) / max(1, seen[f"p{k}"] + seen[f"n{k}"]) for k in cuts}
        k = max(cuts, key=lambda k: (round(worth[k], 6), -k))
        hits = seen[f"p{k}"]
        if hits < LEAST_ROWS or hits < PRECISION * (hits + seen[f"n{k}"]):
            break
        rules.append(grown[:k])
        left = left.where(~_all(grown[:k]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that fits, counted from 1; NULL if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(_all(rules[i]), F.lit(i + 1)).otherwise(out)
    return out


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``id_col``, the base counts, ``base_failed``, ``rule`` and ``kept`` of every row.

    ``base_failed``: fewer than 50 words, or more than half of them repeat. ``rule`` is the number of the
    learnt rule that rejects the row, NULL if none does. Labels: 0 is bad, 1 is good, NULL is
    left out, several labels of an id count as their lowest. NULL texts have no words;
    repeated rows stay repeated; rows with a NULL id are judged but not learnt from. Other
    columns are not looked at. Empty documents give an empty table, empty labels an empty list.
    """
    counted = cut_lineage(st.with_counts(docs, id_col, text_col))
    named = counted.select("*", *[c.alias(n) for n, c in st.features().items()])
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    labelled = named.join(marks, "id").select("id", "label", *st.FEATURES)
    rules = learn(labelled, st.FEATURES, F.col("label") == 0, "id")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = named.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
    )

"""Statistics of a text as column expressions, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import WORD

WINDOW = 3
SYMBOL = "[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_distinct"]
#: what models and rules look at, shares rather than sizes
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "upper", "line_words", "distinct"]


def with_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``hash`` (of the text) and COUNTS of every row; a NULL text counts as empty.

    ``n_dup_lines``: lines with a word that equal an earlier line. ``n_repeat_words``: words inside a
    window of three words that occurs twice or more in the text, first ones included.
    Windows are compared as texts, but only where hashes show that some repeat. A step
    per column keeps the arrays from being built more than once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), text.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD))))
    w = F.col("w")
    starts = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
    rows = rows.withColumn(
        "h", F.transform(F.slice(w, 1, starts), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    )
    twice = F.size(F.array_distinct("h")) < F.size("h")
    windows = F.transform(
        F.slice(w, 1, starts),
        lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")),
    )
    rows = rows.withColumn("sorted", F.when(twice, F.sort_array(windows)))
    s = F.col("sorted")
    same = lambda x, j: F.coalesce(F.get(s, j)["s"] == x["s"], F.lit(False))
    places = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
    rows = rows.withColumn("at", F.sort_array(F.filter(places, lambda p: p.isNotNull())))
    at = F.col("at")
    covered = F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return rows.select(
        "id",
        "hash",
        F.size("w").cast("bigint").alias("n_words"),
        total(F.transform("w", F.char_length)).alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(total(covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
    )


def features() -> dict[str, Column]:
    """FEATURES from COUNTS; 0 where a text has no words or lines."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "line_words": share("n_words", "n_lines"),
        "distinct": share("n_distinct", "n_words"),
    }


def bounded(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, picked by a hash of ``key``; all of them if there are fewer."""
    n = labelled.count()
    if n <= rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * rows / n))


def quantile_edges(labelled: DataFrame, names: list[str], parts: int) -> dict[str, list[float]]:
    """Ascending inner edges per feature, at most ``parts`` - 1 of them."""
    shares = [i / parts for i in range(1, parts)]
    row = labelled.agg(*[F.percentile_approx(n, shares, 10000).alias(n) for n in names]).first()
    return {n: sorted(set(row[n] or [])) for n in names}


def bin_of(name: str, edges: list[float]) -> Column:
    """How many edges lie below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(name)))

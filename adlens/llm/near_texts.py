"""Near copies of texts: the same passages in a large part, whatever their fingerprints say.

A text is the set of its runs of ``SHINGLE`` words (A-Z in lower case), a shorter text is one
run. Two texts are near copies if the Jaccard similarity of their sets is
``line_dedup.SIMILARITY`` or more, and one row of each group of linked texts stays. All such
pairs count, by the set-similarity join of ``line_dedup``. So that a large group costs no pairs
among its texts, texts first meet by SimHash and by leaders; what is verified among these is
one group already, and the join looks for pairs of different groups only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm import line_dedup, simhash
from adlens.llm.components import connected_components
from adlens.llm.tokens import mix, word_hashes
from adlens.session import cut_lineage

SHINGLE = 5


class Shingles(line_dedup.Lines):
    """Sets of runs of SHINGLE words, one set per text with a word."""

    def __init__(self, texts: list[bytes], levels: np.ndarray | None = None):
        starts, words = word_hashes(b"\n".join(texts))
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        n = np.bincount(text, minlength=len(texts))
        place, count = np.arange(len(words)) - (np.cumsum(n) - n)[text], n[text]
        total = np.minimum(count, SHINGLE).astype(np.uint64)
        for k in range(SHINGLE):
            here = np.flatnonzero(place + k < count)
            total[here] += words[here + k] * np.uint64(2 * int(mix(np.array([k + 1]))[0] >> np.uint64(1)) | 1)
        whole = (place + SHINGLE <= count) | ((place == 0) & (count < SHINGLE))
        self.text = self._gather(mix(total)[whole], text[whole].astype(np.uint64), levels)
        self.number = np.zeros(len(self.text), dtype=np.int64)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _met_early(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs of sets to look at first: by equal or linked fingerprints (``key``, ``fp``), and by leaders."""
    heads = cut_lineage(prints.groupBy("fp").agg(F.min("key").alias("head")))
    same = prints.join(heads, "fp").select(F.col("key").alias("a"), F.col("head").alias("b"))
    a, b = heads.toDF("a", "head_a"), heads.toDF("b", "head_b")
    linked = simhash.links(heads).join(a, "a").join(b, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return _ordered(same.unionByName(linked).unionByName(line_dedup._leaders(texts, Shingles))).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``hash`` (of the text) and ``component`` of every row; NULL if the text has no word."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), text.alias("t"))
    marked = cut_lineage(simhash.fingerprints(docs, id_col, text_col))
    scanned = cut_lineage(line_dedup._scan(texts, Shingles))
    levels = line_dedup.rarity_levels(scanned)
    keys = cut_lineage(scanned.where("key is not null").select("hash", "key").distinct())
    prints = marked.select("hash", "fp").distinct().join(keys, "hash").select("key", "fp").distinct()
    early = cut_lineage(_met_early(texts, cut_lineage(prints)))
    early = cut_lineage(line_dedup._matching(texts, early, Shingles))
    groups = connected_components(early, "a", "b").select(F.col("node").alias("key"), F.col("root").alias("done"))
    left = cut_lineage(line_dedup._candidates(texts, levels, cut_lineage(groups), Shingles))
    rest = line_dedup._matching(texts, left, Shingles)
    roots = connected_components(early.unionByName(rest), "a", "b")
    found = keys.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return marked.select("id", "hash").join(found.select("hash", F.coalesce("root", "key").alias("component")), "hash", "left")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, with all its columns.

    A NULL id comes last; of rows with equal ids the smallest hash of the text decides, and
    of rows with equal id and text one stays. Texts without words are copies of each other.
    An empty table gives an empty table.
    """
    return simhash.keep_first(docs, classes(docs, id_col, text_col), id_col, text_col)

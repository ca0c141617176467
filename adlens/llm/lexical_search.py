"""The best documents for each test item by weighted term counts.

Documents are stored once as blocks of postings of the terms that items ask for. In a block
the documents of an item are grouped by their presence mask, one bit per term of the item
that the document holds. A mask has a highest possible score: the weight of its
terms times the largest share any document of the block reaches with each. Masks are
taken by that figure, highest first, until it falls below the worst of the item's
best documents so far; what is left cannot enter the list.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from adlens.llm.tokens import text_groups, word_hashes
from adlens.session import cut_lineage

#: letters and digits of ASCII, and all bytes of other characters, belong to terms
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: documents and postings of a block, at most; a single document is never cut
BLOCK_DOCS, BLOCK_POSTINGS = 32_768, 2_000_000
#: terms of the items that are searched at once, and so the size of a broadcast
ITEM_TERMS = 1_000_000
#: masks that are scored at first; each further step takes twice as many
FIRST_MASKS = 64
SCALE, FREE, LENGTH_SHARE, LENGTH_FACTOR = 1_000_000_000, 1000, 75, 8


def terms(text: str | None) -> np.ndarray:
    """Hashes of the terms of a text in order, A-Z in lower case; a hash of 64 bits stands for the term."""
    return word_hashes((text or "").encode(), NO_TERM)[1]


def _item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(item, hashes) of the items in blocks of bounded size, one block at a time."""
    rows = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # two characters at least make a term and its end
    size = rows.agg(F.sum(F.octet_length("t") / 2 + 1)).first()[0] or 0
    count = max(1, math.ceil(2 * size / ITEM_TERMS))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "t"), F.lit(count)) == k) if count > 1 else rows
        yield [(r.item, terms(r.t)) for r in part.orderBy("item", "t").collect()]


class _Postings:
    """Documents of a task that wait to be written as a block."""

    def __init__(self):
        self.ids, self.lengths, self.rows, self.docs, self.postings = [], [], [], 0, 0

    def add(self, ids: pa.Array, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.rows.append((doc + self.docs, term, times))
        self.docs += len(ids)
        self.postings += len(doc)

    def block(self, names: list[str]) -> pa.RecordBatch:
        """One row: ids in ascending order, NULL last, and postings by term and document."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term, times = (np.concatenate(c) for c in zip(*self.rows))
        doc = place[doc]
        by = np.lexsort((doc, term))
        lists = [ids.take(pa.array(order)), np.concatenate(self.lengths)[order], *(v[by].astype(np.int32) for v in (doc, term, times))]
        columns = [pa.ListArray.from_arrays([0, len(values)], values if isinstance(values, pa.Array) else pa.array(values)) for values in lists]
        return pa.RecordBatch.from_arrays(columns, names)


def _index(rows: DataFrame, vocabulary) -> DataFrame:
    """Blocks of postings of the terms in the vocabulary, for every document that has a term."""
    names = ["ids", "lengths", "docs", "terms", "times"]
    schema = f"ids array<{rows.schema['id'].dataType.simpleString()}>, lengths array<bigint>, docs array<int>, terms array<int>, times array<int>"

    def run(batches):
        known = vocabulary.value
        held = _Postings()
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                starts, hashes = word_hashes(b" ".join(texts), NO_TERM)
                ends = np.cumsum([len(t) + 1 for t in texts])
                doc = np.searchsorted(ends, starts, "right")
                lengths = np.bincount(doc, minlength=len(texts))
                there = np.flatnonzero(lengths)
                if not len(there):
                    continue
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                asked = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                code, times = np.unique(doc[asked] * (len(known) + 1) + at[asked], return_counts=True)
                doc, term = np.divmod(code, len(known) + 1)
                held.add(batch.column(0).take(pa.array(there + first)), lengths[there], np.searchsorted(there, doc), term, times)
                if held.docs >= BLOCK_DOCS or held.postings >= BLOCK_POSTINGS:
                    yield held.block(names)
                    held = _Postings()
        if held.docs:
            yield held.block(names)

    return rows.mapInArrow(run, schema)


class Question:
    """An item's distinct terms, by number in the vocabulary, and the weight of each, repeats included."""

    def __init__(self, hashes: np.ndarray, vocabulary: np.ndarray, weights: np.ndarray):
        term, times = np.unique(np.searchsorted(vocabulary, hashes), return_counts=True)
        self.terms, self.weights = term, weights[term] * times


class Block:
    """Postings of one block with the share each document reaches with a term."""

    def __init__(self, lengths: np.ndarray, docs: np.ndarray, term: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int):
        self.size, self.docs = len(lengths), docs
        # lengths times documents may leave 64 bits before the division
        distinct, where = np.unique(lengths, return_inverse=True)
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * n_docs // n_terms for n in distinct], np.int64)[where]
        self.share = SCALE * times // (FREE * times + LENGTH_FACTOR * m[docs])
        self.known, starts = np.unique(term, return_index=True)
        self.starts = np.append(starts, len(term))
        self.highest = np.maximum.reduceat(self.share, starts) if len(term) else self.share

    def best(self, question: Question, wanted: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (place in the block) and scores of all that may be among the ``wanted`` best.

        ``least`` is a score that ``wanted`` documents of other blocks reach already; a
        document with just that score may still win by its id.
        """
        there = np.isin(question.terms, self.known, assume_unique=True)
        at = np.searchsorted(self.known, question.terms[there])
        weights = question.weights[there]
        spans = list(zip(self.starts[at], self.starts[at + 1]))
        # bit k of a document's mask: it holds the k-th of these terms
        masks = np.zeros((self.size, len(spans) // 64 + 1), np.uint64)
        for k, (a, b) in enumerate(spans):
            masks[self.docs[a:b], k // 64] |= np.uint64(1 << k % 64)
        matched = np.flatnonzero(masks.any(axis=1))
        masks = masks[matched]
        if masks.shape[1] == 1:
            distinct, group = np.unique(masks[:, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, group = np.unique(masks, axis=0, return_inverse=True)
            group = group.ravel()
        bound = np.zeros(len(distinct), np.int64)
        for k, (weight, highest) in enumerate(zip(weights, self.highest[at])):
            bound += (distinct[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int64) * (weight * highest)
        order = np.argsort(-bound, kind="stable")
        members = np.argsort(group, kind="stable")
        first = np.searchsorted(group[members], np.arange(len(distinct) + 1))
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, step = 0, FIRST_MASKS
        while done < len(order) and bound[order[done]] >= max(least, 1):
            taken = order[done : done + step]
            taken = taken[bound[taken] >= max(least, 1)]
            done, step = done + step, 2 * step
            docs = np.sort(matched[np.concatenate([members[first[g] : first[g + 1]] for g in taken])])
            score = np.zeros(len(docs), np.int64)
            for weight, (a, b) in zip(weights, spans):
                near = np.minimum(np.searchsorted(self.docs[a:b], docs), b - a - 1)
                score += np.where(self.docs[a:b][near] == docs, weight * self.share[a:b][near], 0)
            found, scores = np.concatenate([found, docs]), np.concatenate([scores, score])
            # documents are in the order of their ids: the smaller place wins a tie
            top = np.lexsort((found, -scores))[:wanted]
            found, scores = found[top], scores[top]
            if len(scores) == wanted:
                least = max(least, int(scores[-1]))
        good = scores > 0
        return found[good], scores[good]


def _search(index: DataFrame, asked, wanted: int, n_docs: int, n_terms: int, id_type: pa.DataType) -> DataFrame:
    """Best documents of each task for every item, by the item's number in the block of items."""
    schema = f"number bigint, id {index.schema['ids'].dataType.elementType.simpleString()}, score bigint"

    def run(batches):
        questions = asked.value
        best: list[list[tuple]] = [[] for _ in questions]
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                block = Block(*(batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in range(1, 5)), n_docs, n_terms)
                for question, held in zip(questions, best):
                    least = held[-1][0] if len(held) == wanted else 0
                    docs, scores = block.best(question, wanted, least)
                    if len(docs):
                        found = [(s, d is None, d) for s, d in zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist())]
                        held[:] = heapq.nsmallest(wanted, held + found, key=lambda x: (-x[0], x[1], x[2] if not x[1] else 0))
        rows = [(k, d, s) for k, held in enumerate(best) for s, _, d in held]
        if rows:
            number, ids, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids, id_type), pa.array(score, pa.int64())],
                                             ["number", "id", "score"])

    return index.mapInArrow(run, schema)


def _first(rows: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= wanted)


def rank_documents(
    docs: DataFrame, items: DataFrame, wanted: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank``, ``id_col``, ``score``: the ``wanted`` best documents of each item, ties to the smaller id.

    Terms are runs of ASCII letters and digits and of other characters than ASCII. A term in
    df of N documents weighs floor(1000 ln((2N + 2) / (2 df + 1))); the score sums
    weight times share over the item's terms, repeats included. Documents without a term
    do not count; NULL and empty texts have none; items without a term, or whose terms occur
    nowhere, have no rows. Repeated documents are documents of their own, as are repeated
    items; NULL ids come last. Other columns are not looked at; empty tables give an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    id_type, item_type = to_arrow_type(rows.schema["id"].dataType), items.schema[item_col].dataType
    found = None
    for block in _item_blocks(items, item_col, item_text):
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, h in block]]))
        vocabulary = spark.sparkContext.broadcast(known)
        index = cut_lineage(_index(rows, vocabulary))
        totals = index.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()
        n_docs, n_terms = totals[0] or 0, totals[1] or 0
        # a posting per document and term; a count per term of the items, whatever the corpus
        held = np.zeros(len(known), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            held[r.term] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        asked = spark.sparkContext.broadcast([Question(h, known, weights) for _, h in block])
        best = _search(index, asked, wanted, n_docs, n_terms, id_type)
        # many tasks: their lists shrink by parts before an item's rows meet
        best = _first(best.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))), ["number", "part"], wanted).drop("part", "rank")
        best = _first(best, ["number"], wanted)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"number bigint, item {item_type.simpleString()}")
        made = cut_lineage(best.join(names, "number").select(F.col("item").alias("item_id"), "rank", F.col("id").alias(id_col), "score"))
        vocabulary.unpersist()
        asked.unpersist()
        found = made if found is None else found.unionByName(made)
    return found

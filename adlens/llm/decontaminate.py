"""Benchmark passages in training documents, found with spaced seeds.

A seed is a fixed mask over consecutive words; positions that the mask leaves out may
hold any word. Test items and documents are hashed under the same masks; where hashes
meet, the item is laid along the document and the equal words are counted, so replaced
words are tolerated. An item is found if a stretch of the overlap that is long enough has
at least the wanted share of equal words.

The test items are the query set. Their hashes go to the tasks in blocks of bounded
size; the documents are read once per block and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from adlens.llm.tokens import mix, text_groups, word_hashes

#: 1: the word counts, 0: any word. Every overlap that `verify` accepts is hit: a longer one holds a stretch of 13 to 25
#: words with the wanted share, and the tests lay the masks along all of those
MASKS = ("111111", "11011011", "110100111", "10110010011", "1101010011")
#: the same for items of up to LEAST_WORDS words
SHORT_MASKS = ("1111", "11011", "11101", "10111")
#: an overlap of so many words is evidence, or the whole item if it is shorter
LEAST_WORDS = 13
SIMILARITY = 0.8
#: items of fewer words are no passages
SHORTEST_ITEM = 5
#: words of test items that go to the tasks at once, and so the size of a broadcast
BLOCK_WORDS = 2_000_000


def normalized(text: Column) -> Column:
    """Letters and digits in lower case, the rest as single blanks."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", " ")


def _offsets(mask: str) -> np.ndarray:
    return np.array([i for i, c in enumerate(mask) if c == "1"])


def _seeds(hashes: np.ndarray, offsets: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the masked words from every position on; masks by number hash alike words differently."""
    n = max(0, len(hashes) - int(offsets[-1]))
    total = np.zeros(n, dtype=np.uint64)
    factors = mix(np.arange(64 * mask, 64 * mask + len(offsets), dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    for offset, factor in zip(offsets, factors):
        total += hashes[offset : offset + n] * factor
    return total


class Items:
    """Seeds of a block of test items under all masks, sorted for look-up behind a filter by their first bits."""

    def __init__(self, items: list[tuple]):
        self.ids = [x[0] for x in items]
        self.words = [x[1] for x in items]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        owner = np.repeat(np.arange(len(items)), sizes)
        begin = np.cumsum(sizes) - sizes
        masks = MASKS + (SHORT_MASKS if (sizes <= LEAST_WORDS).any() else ())
        self.offsets = [_offsets(m) for m in masks]
        hashes = np.concatenate([*self.words, np.zeros(0, dtype=np.uint64)])
        seeds, places = [], []
        for m, offsets in enumerate(self.offsets):
            seed = _seeds(hashes, offsets, m)
            at = np.flatnonzero(owner[: len(seed)] == owner[int(offsets[-1]) :][: len(seed)])
            if m >= len(MASKS):
                at = at[sizes[owner[at]] <= LEAST_WORDS]
            seeds.append(seed[at])
            places.append(at)
        seed, at = (np.concatenate([*x]) for x in (seeds, places)) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(seed, kind="stable")
        self.known, at = seed[order], at[order]
        self.item = owner[at]
        self.place = at - begin[self.item]
        bits = max(16, int(len(seed)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[self.known >> self.shift] = True

    def hits(self, hashes: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Rows (text, item, place in the text where the item's first word would stand), each once, in order.

        ``hashes`` are the words of some texts on end, ``owner`` the text of a word, ``begin`` a text's first word."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for m, offsets in enumerate(self.offsets):
            seed = _seeds(hashes, offsets, m)
            at = np.flatnonzero(self.filter[seed >> self.shift])
            at = at[owner[at] == owner[at + offsets[-1]]]
            low = np.searchsorted(self.known, seed[at], "left")
            count = np.searchsorted(self.known, seed[at], "right") - low
            index = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at = np.repeat(at, count)
            found.append(np.stack([owner[at], self.item[index], at - begin[owner[at]] - self.place[index]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, texts: list[bytes]) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """(text, item, what `verify` says) of every place where an item is found, ordered by text and item."""
        starts, hashes = word_hashes(b"\n".join(texts))
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
        begin = np.concatenate([[0], ends[:-1]])
        for text, item, start in self.hits(hashes, owner, begin).tolist():
            seen = self.verify(hashes[begin[text] : ends[text]], item, start)
            if seen:
                yield text, item, seen

    def verify(self, hashes: np.ndarray, item: int, start: int) -> tuple[int, int, int] | None:
        """(first word, words, equal words) of the longest good stretch of the overlap."""
        words = self.words[item]
        a, b = max(0, start), min(len(hashes), start + len(words))
        equal = hashes[a:b] == words[a - start : b - start]
        n = len(equal)
        need = min(LEAST_WORDS, len(words))
        if n < need:
            return None
        sums = np.concatenate([[0], np.cumsum(equal)])
        if sums[-1] >= SIMILARITY * n:
            return a, n, int(sums[-1])
        # longest stretch whose share of equal words reaches SIMILARITY: a prefix-sum pair search
        score = sums - SIMILARITY * np.arange(n + 1)
        least = np.minimum.accumulate(score)
        best = None
        for end in range(need, n + 1):
            begin = int(np.searchsorted(-least[: end + 1], -(score[end] + 1e-9), "left"))
            if begin <= end - need and (best is None or end - begin > best[1] - best[0]):
                best = (begin, end)
        return None if best is None else (a + best[0], best[1] - best[0], int(sums[best[1]] - sums[best[0]]))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Test items in blocks of bounded size."""
    rows = benchmark.select(F.col(item_col).alias("item"), normalized(F.col(text_col)).alias("t"))
    rows = rows.withColumn("n", F.size(F.split(F.trim("t"), " "))).where(F.col("t") != "")
    words = rows.agg(F.sum("n")).first()[0] or 0
    count = max(1, math.ceil(2 * words / BLOCK_WORDS))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "t"), F.lit(count)) == k) if count > 1 else rows
        items = [(r.item, word_hashes(r.t.encode())[1]) for r in part.orderBy("item", "t").collect()]
        yield [x for x in items if len(x[1]) >= SHORTEST_ITEM]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row per document and test item found in it: ``id_col``, ``item_id``, ``first_word``, ``n_words``, ``n_equal``.

    ``first_word`` counts the words of letters and digits from 0; of several places the one
    with the most equal words is given, then the first. NULL or empty texts and items
    match nothing, items under five words are no passages. Repeated documents
    give repeated rows, repeated items give a row each. Other columns are not
    looked at; ``carry`` names columns to keep. Empty tables give an empty table.
    """
    kept = [c for c in carry]
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(kept)],
                       normalized(F.col(text_col)).cast("binary").alias("t"))
    item_type = benchmark.schema[item_col].dataType.simpleString()
    types = [to_arrow_type(benchmark.schema[item_col].dataType), pa.int64(), pa.int64(), pa.int64()]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{head}, item {item_type}, first_word bigint, n_words bigint, n_equal bigint"
    found = None
    for block in _blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = Items(shared.value)
            for batch in batches:
                where, out = [], []
                for first, texts in text_groups(batch.column(batch.num_columns - 1)):
                    best: dict[tuple[int, int], tuple] = {}
                    for text, item, seen in items.overlaps(texts):
                        held = best.get((text, item))
                        if held is None or (seen[2], -seen[0]) > (held[2], -held[0]):
                            best[text, item] = seen
                    for (text, item), seen in best.items():
                        where.append(first + text)
                        out.append((items.ids[item], *seen))
                if not out:
                    continue
                taken = pa.array(where, type=pa.int64())
                columns = [c.take(taken) for c in batch.columns[:-1]]
                made = [pa.array([r[k] for r in out], type=types[k]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*batch.schema.names[:-1], "item", "first_word", "n_words", "n_equal"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("id").alias(id_col), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)],
                        F.col("item").alias("item_id"), "first_word", "n_words", "n_equal")


def _is_clean(shared):
    """Function over normalized texts: no item of the block is found."""

    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(shared.value)
        for column in columns:
            good = np.ones(len(column), dtype=bool)
            for first, texts in text_groups(column):
                good[[first + text for text, _, _ in items.overlaps(texts)]] = False
            yield pa.array(good)

    return F.arrow_udf(clean, "boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with all their columns.

    NULL and empty texts stay, repeated rows stay or go together, NULL ids matter nothing. An
    empty table gives an empty table, an empty benchmark gives all rows.
    The decision needs a row's own text only, so rows are filtered where they are read:
    one pass per block of test items, nothing is shuffled.
    """
    left = docs
    for block in _blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        left = left.where(_is_clean(shared)(normalized(F.col(text_col)).cast("binary")))
    return left

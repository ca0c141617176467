"""Repeated and nearly repeated lines, by an exact set-similarity join.

A line is the set of its words (A-Z in lower case). Two lines match if the Jaccard
similarity of their sets is SIMILARITY or more; a line goes if a line that matches it
comes earlier, by document and place. Steps:

* Words are ordered by how rare they are in the whole table (counts in slots of a hash; any
  order gives the same matches, a good one few candidates). A set's first words by this order
  are its prefix: sets that match share a word of their prefixes.
* Equal sets become one; its copies are told apart again at the end.
* Sets meet on prefix words, filtered by their sizes, by the most words they can still share
  given the places of the word in both, and by a signature: one bit per word, added modulo 2,
  so that different bits are never more than different words. The rest is verified on the
  whole sets.
* A common word is no key by itself. With a prefix that is one word longer, sets that match
  share two words; if the first of them is common, both together are the key.
* Removal needs one earlier match of a set, not all. So where links are not counted, sets first
  meet an early set that shares two of their least words under some hashes (a leader); those
  that match it and come later are settled. In the join above a pair needs one set that is not
  settled, so a large group of nearly equal lines costs no pairs among its settled sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import fresh
from adlens.llm.tokens import mix, text_groups, word_hashes
from adlens.session import cut_lineage

SIMILARITY = 0.8
SLOT_BITS = 17
#: steps of the rarity scale per factor of two
STEPS = 64
#: words of a slot with more words than this are common
COMMON = 1_000_000
MAP_BITS = 22
#: bits of the signature that candidates must pass before their words are read
WIDE = 512
KEY_BITS = 40
#: sets of more words bring MORE further signatures of 64 bits, as one says little about them; others bring zeros
LONG = 80
MORE = 3
#: least words of a set under so many hashes; two of them together lead to a leader
LEAST_WORDS = 3


def _least_overlap(n):
    """Words that a set of n words shares at least with any set that matches it."""
    return np.ceil(SIMILARITY * n - 1e-9).astype(np.int64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _settle_ties(line: np.ndarray, rank: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order in which words of one line whose hashes agree in the upper 32 bits stand by their whole hashes."""
    order = np.arange(len(hashes))
    upper = hashes >> np.uint64(32)
    tied = (line[1:] == line[:-1]) & (rank[1:] == rank[:-1]) & (upper[1:] == upper[:-1])
    if (tied & (hashes[1:] != hashes[:-1])).any():
        # only runs of ties are sorted again; they stay where they stand
        in_run = np.zeros(len(hashes), dtype=bool)
        in_run[1:] |= tied
        in_run[:-1] |= tied
        at = np.flatnonzero(in_run)
        order[at] = at[np.lexsort((hashes[at], rank[at], line[at]))]
    return order


class Lines:
    """Word sets of the lines of some texts, all lines at once.

    ``text`` and ``number`` of every line with a word, and its ``size``, ``key`` and ``signature``; with
    ``levels`` the words of a line are ordered by rarity.
    """

    def __init__(self, texts: list[bytes], levels: np.ndarray | None = None):
        data = b"\n".join(texts)
        starts, hashes = word_hashes(data)
        line = self._gather(hashes, np.cumsum(np.frombuffer(data, dtype=np.uint8) == 10, dtype=np.int32)[starts].astype(np.uint64), levels)
        starts_of = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
        self.text = np.searchsorted(starts_of, line, "right") - 1
        self.number = line - starts_of[self.text]

    def _gather(self, hashes: np.ndarray, line: np.ndarray, levels: np.ndarray | None) -> np.ndarray:
        """Sets of the hashes with the same line; returns the line of each set."""
        self.hashes = hashes
        rank = np.zeros(len(hashes), dtype=np.uint64) if levels is None else levels[_slot(hashes)].astype(np.uint64)
        if len(line) and int(line[-1]) >> 20:
            order = np.lexsort((hashes, rank, line))
        else:
            # 20 bits of line, 12 of rarity, 32 of hash: one sort instead of three
            order = np.argsort(line << np.uint64(44) | rank << np.uint64(32) | hashes >> np.uint64(32))
            order = order[_settle_ties(line[order], rank[order], hashes[order])]
        line, hashes = line[order].astype(np.int64), hashes[order]
        first = np.ones(len(line), dtype=bool)
        first[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        line, self.words = line[first], hashes[first]
        edge = np.ones(len(line), dtype=bool)
        edge[1:] = line[1:] != line[:-1]
        self.begin = np.flatnonzero(edge)
        self.size = np.diff(np.append(self.begin, len(line)))
        if len(self.begin):
            # a sum and a sum of bits modulo 2 do not depend on the order
            sums = np.add.reduceat(mix(self.words), self.begin)
            bits = np.uint64(1) << (self.words & np.uint64(63))
            self.signature = np.bitwise_xor.reduceat(bits, self.begin).view(np.int64)
        else:
            sums, self.signature = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.key = mix(sums + self.size.astype(np.uint64)).view(np.int64)
        return line[self.begin]

    def spans(self, lines: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``words`` of the first ``lengths`` words of the given lines, and where each line starts."""
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return np.repeat(self.begin[lines] - offsets[:-1], lengths) + np.arange(offsets[-1]), offsets


def _new(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the keys that the task has not met yet, once each."""
    _, first = np.unique(keys, return_index=True)
    fresh_ones = [i for i in np.sort(first).tolist() if int(keys[i]) not in seen]
    seen.update(keys[fresh_ones].tolist())
    return np.array(fresh_ones, dtype=np.int64)


def _scan(texts: DataFrame, kind_of: type[Lines] = Lines) -> DataFrame:
    """Two kinds of rows: a line with words (``id``, ``hash``, ``line``, ``key`` of its set), and per task and slot
    the number of words (``slot``, ``n``)."""
    names = ["id", "hash", "line", "key", "slot", "n"]

    def run(batches):
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        kinds = None
        for batch in batches:
            kinds = [batch.column(0).type, batch.column(1).type]
            for first, held in text_groups(batch.column(2)):
                lines = kind_of(held)
                np.add.at(total, _slot(lines.hashes), 1)
                n = len(lines.key)
                at = pa.array(lines.text + first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.number.astype(np.int64)), pa.array(lines.key),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        slot = np.flatnonzero(total)
        if len(slot):
            none = [pa.nulls(len(slot), kind) for kind in [*kinds, pa.int64(), pa.int64()]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(slot), pa.array(total[slot])], names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, hash bigint, line bigint, key bigint, slot bigint, n bigint")


def rarity_levels(scanned: DataFrame) -> np.ndarray:
    """Level per slot of word hashes, higher is more common. One count per slot comes back."""
    counts = scanned.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << SLOT_BITS)
    levels[counts["slot"].to_numpy()] = np.log2(counts["n"].to_numpy()) * STEPS
    return np.minimum(levels, 4095).astype(np.uint16)


def _pair_keys(words: np.ndarray, common: np.ndarray) -> list[tuple[int, int]]:
    """(key, place) of all pairs of a common word and another one."""
    out = {}
    for i in np.flatnonzero(common).tolist():
        for j in range(len(words)):
            if i != j:
                low, high = sorted((int(words[i]), int(words[j])))
                key = int(mix(np.array([(low * 3 + high) & (2**64 - 1)], dtype=np.uint64))[0])
                out[key] = min(i, j)
    return list(out.items())


def _further(lines: Lines, chosen: np.ndarray) -> np.ndarray:
    """MORE columns of signatures: one bit of them all per word, added modulo 2; 0 for sets that are not long."""
    out = np.zeros((len(chosen), MORE), dtype=np.uint64)
    long = np.flatnonzero(lines.size[chosen] > LONG)
    if len(long):
        index, offsets = lines.spans(chosen[long], lines.size[chosen[long]])
        bit = (lines.words[index] >> np.uint64(6)) % np.uint64(64 * MORE)
        for k in range(MORE):
            bits = np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
            out[long, k] = np.bitwise_xor.reduceat(bits, offsets[:-1])
    return out.view(np.int64)


def _postings(texts: DataFrame, levels: np.ndarray, kind_of: type[Lines] = Lines) -> DataFrame:
    """``word`` (a key to meet on), ``key``, ``signature``, ``place`` (size and place packed) and further signatures, per
    set once in a task."""
    further = [f"more{k}" for k in range(MORE)]
    shared = texts.sparkSession.sparkContext.broadcast(levels)
    limit = int(np.log2(COMMON) * STEPS)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, held in text_groups(batch.column(0)):
                lines = kind_of(held, shared.value)
                chosen = _new(lines.key, seen)
                # sets of up to three words match equal sets only
                chosen = chosen[lines.size[chosen] > 3]
                lengths = lines.size[chosen] - _least_overlap(lines.size[chosen]) + 1
                index, offsets = lines.spans(chosen, lengths)
                words = lines.words[index]
                of = np.repeat(np.arange(len(chosen)), lengths)
                at = np.arange(len(index)) - offsets[:-1][of]
                common = shared.value[_slot(words)] > limit
                rows = [(words[~common], of[~common], at[~common])]
                for k in np.unique(of[common]).tolist():
                    line = chosen[k]
                    longer = lines.words[lines.begin[line] : lines.begin[line] + lengths[k] + 1]
                    pairs = _pair_keys(longer, shared.value[_slot(longer)] > limit)
                    rows.append((np.array([p[0] for p in pairs], dtype=np.uint64), np.full(len(pairs), k), np.array([p[1] for p in pairs], dtype=np.int64)))
                words, of, at = (np.concatenate(x) for x in zip(*rows))
                line, more = chosen[of], _further(lines, chosen)[of]
                yield pa.RecordBatch.from_arrays([
                    pa.array((words >> np.uint64(64 - KEY_BITS)).astype(np.int64)), pa.array(lines.key[line]),
                    pa.array(lines.signature[line]), pa.array((lines.size[line] << 32 | at).astype(np.int64)),
                    *[pa.array(np.ascontiguousarray(more[:, k])) for k in range(MORE)]],
                    ["word", "key", "signature", "place", *further])

    schema = "word bigint, key bigint, signature bigint, place bigint, " + ", ".join(f"{c} bigint" for c in further)
    return texts.select("t").mapInArrow(run, schema)


def _leaders(texts: DataFrame, kind_of: type[Lines] = Lines) -> DataFrame:
    """Pairs of a set ``a`` and the first set ``b`` (by id, then key) with two of its least words; at most a few per set."""
    words = [f"w{k}" for k in range(LEAST_WORDS)]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for first, held in text_groups(batch.column(1)):
                lines = kind_of(held)
                chosen = _new(lines.key, seen)
                chosen = chosen[lines.size[chosen] > 3]
                if len(chosen):
                    index, offsets = lines.spans(chosen, lines.size[chosen])
                    seeds = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(LEAST_WORDS)]
                    least = [np.minimum.reduceat(mix(lines.words[index] ^ seed), offsets[:-1]) for seed in seeds]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(lines.text[chosen] + first)), pa.array(lines.key[chosen]),
                        *[pa.array(x.view(np.int64)) for x in least]], ["id", "key", *words])

    kind = texts.schema["id"].dataType.simpleString()
    sets = texts.select("id", "t").mapInArrow(run, f"id {kind}, key bigint, " + ", ".join(f"{w} bigint" for w in words))
    both = [F.xxhash64(F.lit(f"{x}{y}"), x, y) for x, y in itertools.combinations(words, 2)]
    bands = cut_lineage(sets.select("id", "key", F.explode(F.array(*both)).alias("band")))
    lead = bands.groupBy("band").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("lead"), F.max("key").alias("most"), F.min("key").alias("least")
    )
    # a band that holds one set only leads nowhere
    lead = lead.where("most <> least").select("band", F.col("lead.key").alias("b"))
    return bands.select("band", F.col("key").alias("a")).join(lead, "band").where("a <> b").select("a", "b").distinct()


def _candidates(
    texts: DataFrame, levels: np.ndarray, settled: DataFrame | None = None, kind_of: type[Lines] = Lines
) -> DataFrame:
    """Pairs of sets (``a`` before ``b`` by size, then key) that pass all filters. ``settled`` has ``key`` and
    ``done``; a pair with equal ``done`` is left out."""
    rows = _postings(texts, levels, kind_of)
    known = F.lit(False)
    if settled is not None:
        rows = rows.join(settled.select("key", "done"), "key", "left")
        known = F.coalesce(F.col("done_a") == F.col("done_b"), F.lit(False))
    # one exchange serves the removal of copies from several tasks and both sides of the join
    rows = rows.repartition("word").dropDuplicates(["word", "key"])
    columns = [c for c in rows.columns if c != "word"]
    x = rows.select("word", *[F.col(c).alias(f"{c}_a") for c in columns])
    y = rows.select("word", *[F.col(c).alias(f"{c}_b") for c in columns])
    n_a, n_b = (F.shiftright(f"place_{s}", 32) for s in "ab")
    at_a, at_b = (F.col(f"place_{s}").bitwiseAND(F.lit(2**32 - 1)) for s in "ab")
    before = (n_a < n_b) | ((n_a == n_b) & (F.col("key_a") < F.col("key_b")))
    sizes = n_a >= n_b * SIMILARITY - 1e-9
    most = (n_a + n_b) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9
    differ = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    further = sum((differ(f"more{k}") for k in range(MORE)), F.lit(0))
    close = (differ("signature") <= most) & ((n_a <= LONG) | (n_b <= LONG) | (further <= most))
    # at the first shared word all words to share are still to come, in both sets
    needed = F.ceil((n_a + n_b) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    first = (at_a + needed <= n_a) & (at_b + needed <= n_b)
    return x.join(y, "word").where(before & sizes & close & first & ~known).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def _bitmap(numbers: DataFrame) -> np.ndarray:
    """Which slots of a fixed number hold one of the ``x``, by their highest bits."""
    # counted from 1, as the bitmap functions do
    slots = numbers.select((F.shiftrightunsigned("x", 64 - MAP_BITS) + 1).alias("slot"))
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    ).collect()
    found = np.zeros(1 << MAP_BITS, dtype=bool)
    for bucket, bits in rows:
        at = (bucket - 1) * 32768
        found[at : at + 32768] |= np.unpackbits(np.frombuffer(bytes(bits), dtype=np.uint8), bitorder="little").astype(bool)
    return found


def _chosen(texts: DataFrame, pairs: DataFrame, made, schema: str, kind_of: type[Lines] = Lines) -> DataFrame:
    """Rows of ``made(lines, chosen)`` for the sets of ``pairs`` (and a few more), one per set."""
    wanted = _bitmap(pairs.select(F.col("a").alias("x")).union(pairs.select("b")))
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            for _, held in text_groups(batch.column(0)):
                lines = kind_of(held)
                slots = (lines.key.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                chosen = np.flatnonzero(flags[slots])
                yield made(lines, chosen[_new(lines.key[chosen], seen)])

    return texts.select("t").mapInArrow(run, schema).dropDuplicates(["key"])


def _wide(lines: Lines, chosen: np.ndarray) -> pa.RecordBatch:
    """``key``, ``size`` and a signature of WIDE bits in numbers of 64."""
    index, offsets = lines.spans(chosen, lines.size[chosen])
    flips = np.zeros((len(chosen), WIDE), dtype=np.uint8)
    of = np.repeat(np.arange(len(chosen)), lines.size[chosen])
    np.bitwise_xor.at(flips, (of, (lines.words[index] >> np.uint64(6)) % np.uint64(WIDE)), 1)
    bits = np.packbits(flips, axis=1).view(np.int64)
    columns = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WIDE // 64)]
    names = ["key", "size", *[f"s{k}" for k in range(WIDE // 64)]]
    return pa.RecordBatch.from_arrays([pa.array(lines.key[chosen]), pa.array(lines.size[chosen].astype(np.int64)), *columns], names)


def _words(lines: Lines, chosen: np.ndarray) -> pa.RecordBatch:
    """``key`` and ``words`` of whole sets."""
    index, offsets = lines.spans(chosen, lines.size[chosen])
    words = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(lines.words[index].view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(lines.key[chosen]), words], ["key", "words"])


def _wide_and_words(lines: Lines, chosen: np.ndarray) -> pa.RecordBatch:
    wide, words = _wide(lines, chosen), _words(lines, chosen)
    return pa.RecordBatch.from_arrays([*wide.columns, words.column(1)], [*wide.schema.names, "words"])


_PARTS = [f"s{k}" for k in range(WIDE // 64)]
_SIGNED = "key bigint, size bigint, " + ", ".join(f"{c} bigint" for c in _PARTS)


def _close(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose wide signatures differ in no more bits than matching sets in words."""
    parts = _PARTS
    x = sets.select(F.col("key").alias("a"), F.col("size").alias("n_a"), *[F.col(c).alias(f"{c}_a") for c in parts])
    y = sets.select(F.col("key").alias("b"), F.col("size").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in parts])
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in parts), F.lit(0))
    most = (F.col("n_a") + F.col("n_b")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9
    return pairs.join(x, "a").join(y, "b").where(differ <= most).select("a", "b")


def matches(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """``a``, ``b``: all pairs of different sets whose similarity is SIMILARITY or more."""
    return _matching(texts, cut_lineage(_candidates(texts, levels)))


def late_sets(texts: DataFrame, levels: np.ndarray, firsts: DataFrame) -> DataFrame:
    """``key`` of every set that matches another one whose ``first`` place is earlier."""

    def later(pairs: DataFrame) -> DataFrame:
        a = firsts.select(F.col("key").alias("a"), F.col("first").alias("first_a"))
        b = firsts.select(F.col("key").alias("b"), F.col("first").alias("first_b"))
        return pairs.join(a, "a").join(b, "b").select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("key"))

    # many leaders do not match, so words are read for those only that pass the signature
    led = cut_lineage(_leaders(texts))
    led = cut_lineage(_close(cut_lineage(_chosen(texts, led, _wide, _SIGNED)), led))
    led = _verified(cut_lineage(_chosen(texts, led, _words, "key bigint, words array<bigint>")), led)
    settled = cut_lineage(later(led).distinct())
    rest = _matching(texts, cut_lineage(_candidates(texts, levels, settled.withColumn("done", F.lit(True)))))
    return settled.unionByName(later(rest)).distinct()


def _matching(texts: DataFrame, pairs: DataFrame, kind_of: type[Lines] = Lines) -> DataFrame:
    """The pairs whose similarity is SIMILARITY or more; signatures and words come out of one pass over the texts."""
    sets = cut_lineage(_chosen(texts, pairs, _wide_and_words, f"{_SIGNED}, words array<bigint>", kind_of))
    close = cut_lineage(_close(sets, pairs))
    asked = _in_bitmap(_bitmap(close.select(F.col("a").alias("x")).union(close.select("b"))), texts.sparkSession)
    return _verified(cut_lineage(sets.where(asked("key")).select("key", "words")), close)


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose similarity is SIMILARITY or more; ``sets`` has the ``words`` of each ``key`` in them.

    Both sides come by a join on the key of a set: nothing is held whole by the driver or by a task.
    """
    x = sets.select(F.col("key").alias("a"), F.col("words").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("words").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return pairs.join(x, "a").join(y, "b").where(shared >= SIMILARITY * union - 1e-9).select("a", "b")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``id``, ``hash`` (of the text), ``repeats`` (numbers of the lines that go, from 0) and ``n_links`` (for
    each of its lines the other lines of the table that match it, equal ones included; out of counts per set, copies
    are not expanded) of every text that has any of them. Without
    ``counts`` the same lines go, but not all pairs are looked for and ``n_links`` is 0."""
    texts = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")
    )
    scanned = cut_lineage(_scan(texts))
    lines = scanned.where("key is not null").select("id", "hash", "line", "key")
    # a NULL id comes last
    place = F.struct(F.col("id").isNull().alias("last"), "id", "hash", "line")
    levels = rarity_levels(scanned)
    firsts = cut_lineage(lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")))
    if not counts:
        late = late_sets(texts, levels, firsts).withColumn("late", F.lit(True))
        judged = lines.join(firsts.join(late, "key", "left").where("copies > 1 or late").select("key", "first", "late"), "key")
        gone = judged.where(F.col("late").isNotNull() | (place > F.col("first")))
        return gone.groupBy("id", "hash").agg(F.sort_array(F.collect_set("line")).alias("repeats"), F.lit(0).cast("bigint").alias("n_links"))
    found = cut_lineage(matches(texts, levels))
    ends = found.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(
        found.select(F.col("b").alias("key"), F.col("a").alias("other"))
    )
    met = ends.join(firsts.select(F.col("key").alias("other"), F.col("first").alias("met"), F.col("copies").alias("met_copies")), "other")
    near = met.groupBy("key").agg(F.min("met").alias("met"), F.sum("met_copies").alias("links"))
    earliest = firsts.join(near, "key", "left").where("copies > 1 or links is not null").select(
        "key", F.least("first", F.coalesce("met", "first")).alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    judged = lines.select("id", "hash", "line", "key").join(earliest, "key")
    gone = F.when(place > F.col("first"), F.col("line"))
    return judged.groupBy("id", "hash").agg(
        F.sort_array(F.collect_set(gone)).alias("repeats"), F.sum("links").cast("bigint").alias("n_links")
    ).where("size(repeats) > 0 or n_links > 0")


def _in_bitmap(bitmap: np.ndarray, spark):
    """Function of a number: is its slot in the bitmap?"""
    shared = spark.sparkContext.broadcast(np.packbits(bitmap))

    def test(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flags = np.unpackbits(shared.value).astype(bool)
        for column in columns:
            numbers = column.to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.array(flags[(numbers >> np.uint64(64 - MAP_BITS)).astype(np.int64)])

    return F.arrow_udf(test, "boolean")


def _without(text: Column, repeats: Column) -> Column:
    def rest(lines: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(repeats, lambda x: x.cast("int")))
        return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")

    # as a variable the lines are split once, not once per line
    return F.transform(F.array(F.split(text, "\n")), rest)[0]


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` without the lines that an earlier line matches; with ``counts`` also ``n_lines``, ``n_removed``, ``n_links``.

    Lines are what stands between line feeds; a line without a word is never removed.
    Earlier is by id (NULL last), then by a hash of the text, then by place; so rows
    with equal id and text are not earlier than each other and lose the same lines. A text
    may become empty; its row stays. NULL texts stay NULL. All columns are kept, a column
    that has the name of a count is replaced by it. An empty table gives an empty table.
    """
    repeats = cut_lineage(find_repeats(docs, id_col, text_col, counts))
    names = fresh(docs, "line_id", "line_hash", "line_repeats", "line_links")
    i, h, r, n = names
    marks = repeats.toDF(i, h, r, n)
    # texts that surely have no mark need not travel
    marked = _in_bitmap(_bitmap(repeats.select(F.xxhash64("id", "hash").alias("x"))), docs.sparkSession)
    maybe = marked(F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    some, rest = docs.where(maybe), docs.where(~maybe)
    same = some[id_col].eqNullSafe(marks[i]) & (F.xxhash64(some[text_col]) == marks[h])
    nothing = rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema])
    joined = some.join(marks, same, "left").unionByName(nothing)
    text = F.when(F.size(r) > 0, _without(F.col(text_col), F.col(r))).otherwise(F.col(text_col))
    out = joined.withColumn(text_col, text)
    if counts:
        before = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(F.col(text_col), "\n")))
        out = joined.select(
            *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (text_col.lower(), "n_lines", "n_removed", "n_links")],
            text.alias(text_col), before.cast("bigint").alias("n_lines"),
            F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0)).cast("bigint").alias("n_removed"),
            F.coalesce(F.col(n), F.lit(0)).alias("n_links"),
        )
        return out
    return out.select(*docs.columns)

"""Near copies by SimHash, linked with the generalised pigeonhole principle.

A fingerprint has 64 bits; two texts are linked if theirs differ in at most ``TAU`` bits.
The bits are dealt to ``PARTS`` parts so that bits that tend to agree stand together.
Every fingerprint then gets one threshold per part (-1: the part is not asked), which add
up to ``TAU - PARTS + 1``; then any fingerprint within ``TAU`` bits lies within the
threshold of some part. A dynamic program picks the thresholds with the fewest estimated
candidates, read from the counts of all part values, so a part whose value is common is
passed over and a rarer one is searched more widely.

Buckets that are large all the same are cut again: what agrees in a part and differs in
at most ``TAU`` of the other bits agrees in one of ``TAU + 1`` shares of those bits. Since only
distinct fingerprints are compared, each cut bounds a bucket by the bits that are left.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import fresh
from adlens.llm.components import connected_components
from adlens.session import cut_lineage

BITS = 64
SHINGLE = 3
SEED = 42
TAU = 3
PARTS = 4
WIDTH = BITS // PARTS
#: a bucket with more rows is cut again
BUCKET = 256
CUTS = 5
#: one more key to look up weighs as much as so many candidates
KEY_COST = 2.0
CHUNK = 1 << 16


def fingerprint(data: bytes) -> int:
    """Fingerprint of one UTF-8 text.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at exactly the six white
    space characters. Shingles are counted in chunks, so a long text needs little memory.
    """
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        shingles = zip(*(part[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [part]
        raw = np.frombuffer(b"".join([digest(b" ".join(s), SEED) for s in shingles]), dtype=np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = ones * 2 > n
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``hash`` (of the text) and ``fp`` (the 64 bits as a signed number) of every row; a NULL text has no words."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = pa.array([fingerprint(x.as_py()) for x in batch.column(2)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], made], ["id", "hash", "fp"])

    return rows.mapInArrow(run, f"id {id_type}, hash bigint, fp bigint")


# ---- statistics of fixed size over all fingerprints


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    """One row per fingerprint, column b is bit b counted from the lowest."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(groups: DataFrame) -> list[list[int]]:
    """Bits dealt to parts of equal width, correlated bits together.

    What comes to the driver is one count per pair of bits.
    """

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = _bit_matrix(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
        a, b = np.triu_indices(BITS)
        n = total[a, b].round().astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    counts = groups.select("fp").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS, BITS))
    for a, b, n in counts.collect():
        both[a, b] = both[b, a] = n
    rows = max(1, groups.count())
    share = np.diag(both) / rows
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tie = np.abs((both / rows - np.outer(share, share)) / np.outer(spread, spread))
    left, parts = list(range(BITS)), []
    while left:
        start = max(left, key=lambda b: (tie[b, [x for x in left if x != b]].max(initial=0.0), -b))
        part = [start]
        left.remove(start)
        while len(part) < WIDTH:
            best = max(left, key=lambda b: (tie[b, part].mean(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def _values(fps: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """Value of every part: one row per part."""
    u = fps.astype(np.uint64)
    out = np.zeros((len(parts), len(u)), dtype=np.int64)
    for i, part in enumerate(parts):
        for k, bit in enumerate(part):
            out[i] |= ((u >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def candidate_counts(groups: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """For part i, threshold e and value v: fingerprints within e bits of v in part i.

    What comes to the driver is one count per part and value, at most PARTS * 2**WIDTH.
    """

    def run(batches):
        total = np.zeros((PARTS, 1 << WIDTH), dtype=np.int64)
        for batch in batches:
            for i, v in enumerate(_values(batch.column(0).to_numpy(zero_copy_only=False), parts)):
                total[i] += np.bincount(v, minlength=1 << WIDTH)
        i, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(v), pa.array(total[i, v])], ["part", "v", "n"])

    counts = (
        groups.select("fp").mapInArrow(run, "part bigint, v bigint, n bigint")
        .groupBy("part", "v").agg(F.sum("n").alias("n")).toArrow()
    )
    at = np.zeros((PARTS, 1 << WIDTH))
    at[counts["part"].to_numpy(), counts["v"].to_numpy()] = counts["n"].to_numpy()
    index = np.arange(1 << WIDTH)

    def step(x: np.ndarray) -> np.ndarray:
        return sum(x[:, index ^ (1 << b)] for b in range(WIDTH))

    exact = [at]
    for e in range(1, TAU + 1):
        farther = step(exact[-1])
        if e > 1:
            farther = farther - (WIDTH - e + 2) * exact[-2]
        exact.append(farther / e)
    return np.cumsum(np.stack(exact, axis=1), axis=1).astype(np.float32)


def allocate(cost: np.ndarray) -> np.ndarray:
    """Cheapest thresholds. ``cost``: rows x parts x (TAU + 2), the last axis from threshold -1.

    The program runs over the parts; its state is the sum that is still to be given.
    """
    rows, parts, choices = cost.shape
    spare = TAU + 1  # the sum of (threshold + 1) over the parts
    best = np.full((rows, spare + 1), np.inf, dtype=np.float32)
    best[:, 0] = 0
    picks = np.zeros((parts, rows, spare + 1), dtype=np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for given in range(spare + 1):
            for e in range(min(choices - 1, given) + 1):
                total = best[:, given - e] + cost[:, i, e]
                better = total < new[:, given]
                new[better, given] = total[better]
                picks[i, better, given] = e
        best = new
    out = np.zeros((rows, parts), dtype=np.int64)
    given = np.full(rows, spare)
    for i in reversed(range(parts)):
        out[:, i] = picks[i, np.arange(rows), given]
        given -= out[:, i]
    return out - 1


def _keys(groups: DataFrame, parts: list[list[int]], counts: np.ndarray) -> DataFrame:
    """``path`` (the part), ``key``, ``fp``, ``held`` (it can be found here), ``asks`` (it looks here)."""
    spark = groups.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    masks = [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), e)], dtype=np.int64) for e in range(TAU + 1)]
    looks = np.cumsum([0] + [len(m) for m in masks]) * KEY_COST

    def run(batches):
        table = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            values = _values(fps, parts)
            cost = np.zeros((len(fps), PARTS, TAU + 2), dtype=np.float32)
            for i in range(PARTS):
                cost[:, i, 1:] = table[i][:, values[i]].T + looks[1:]
            thresholds = allocate(cost)
            for i in range(PARTS):
                asks = thresholds[:, i] >= 0
                yield _batch(i, values[i], fps, True, asks)
                for e in range(1, TAU + 1):
                    far = np.nonzero(thresholds[:, i] >= e)[0]
                    for mask in masks[e] if len(far) else ():
                        yield _batch(i, values[i][far] ^ mask, fps[far], False, np.ones(len(far), bool))

    def _batch(i, key, fps, held, asks):
        n = len(fps)
        arrays = [pa.array(np.full(n, i)), pa.array(key), pa.array(fps), pa.array(np.full(n, held)), pa.array(asks)]
        return pa.RecordBatch.from_arrays(arrays, ["path", "key", "fp", "held", "asks"])

    return groups.select("fp").mapInArrow(run, "path bigint, key bigint, fp bigint, held boolean, asks boolean")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _shares(agreed: set[int]) -> list[list[int]]:
    """The bits that may differ, dealt to TAU + 1 shares."""
    free = [b for b in range(BITS) if b not in agreed]
    return [free[k :: TAU + 1] for k in range(TAU + 1)]


def links(groups: DataFrame) -> DataFrame:
    """``a`` < ``b``: all pairs of distinct fingerprints (column ``fp``) within TAU bits."""
    parts = group_bits(groups)
    rows = cut_lineage(_keys(groups, parts, candidate_counts(groups, parts)))
    agreed = [set(p) for p in parts]
    found = []
    for cut in range(CUTS + 1):
        sizes = rows.groupBy("path", "key").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("asking"), F.count_if("held").alias("holding")
        ).where("asking > 0 and holding > 0 and rows > 1")
        sizes = cut_lineage(sizes.select("path", "key", (F.col("rows") > BUCKET).alias("large")))
        last = cut == CUTS
        small = rows.join(sizes if last else sizes.where("not large"), ["path", "key"])
        x = small.where("asks").select("path", "key", F.col("fp").alias("f"))
        y = small.where("held").select("path", "key", F.col("fp").alias("g"))
        near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= TAU
        pairs = x.join(y, ["path", "key"]).where((F.col("f") != F.col("g")) & near)
        found.append(pairs.select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b")))
        if last or sizes.where("large").isEmpty():
            break
        shares = [_shares(bits) for bits in agreed]
        agreed = [bits | set(share) for bits, cuts in zip(agreed, shares) for share in cuts]
        masks = F.array(*[F.array(*[F.lit(_signed(sum(1 << b for b in s))) for s in cuts]) for cuts in shares])
        split = rows.join(sizes.where("large"), ["path", "key"]).select(
            "path", "key", "fp", "held", "asks", F.posexplode(F.get(masks, F.col("path").cast("int"))).alias("k", "mask")
        )
        # keys that fall together by chance only add candidates, and those are verified
        rows = cut_lineage(split.select(
            (F.col("path") * (TAU + 1) + F.col("k")).alias("path"),
            F.xxhash64("key", "path", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "held", "asks",
        ))
    joined = found[0]
    for more in found[1:]:
        joined = joined.unionByName(more)
    return joined.distinct()


def _classes(marked: DataFrame) -> DataFrame:
    """``fp``, ``component`` (the same for linked fingerprints) and ``component_id`` of every fingerprint."""
    groups = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("least")))
    near = connected_components(links(groups), "a", "b")
    linked = near.join(groups, near["node"] == groups["fp"]).select("fp", "root", "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = linked.join(roots, "root").select("fp", F.col("root").alias("component"), "component_id")
    return groups.join(found, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id")
    )


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id reachable over linked fingerprints, itself
    included. A NULL text counts as empty; texts without words have fingerprint zero and
    are linked like any other. Repeated rows stay repeated. A row with a NULL id is kept;
    its component is the smallest id that is not NULL, or NULL if there is none. Other
    columns are not looked at. An empty table gives an empty table.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col))
    return marked.join(_classes(marked), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns.

    A NULL id comes last; of rows with equal ids the smallest hash of the text decides, and
    of rows with equal id and text one stays.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col))
    return keep_first(docs, marked.join(_classes(marked).select("fp", "component"), "fp"), id_col, text_col)


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each ``component``; ``rows`` has ``id``, ``hash`` and ``component`` of every row of ``docs``."""
    first = rows.groupBy("component", "id", "hash").agg(F.count(F.lit(1)).alias("n"))
    chosen = first.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "hash", "n")).alias("x"))
    chosen = cut_lineage(chosen.select("x.id", "x.hash", "x.n"))
    i, h, n = fresh(docs, "kept_id", "kept_hash", "kept_rows")

    def picked(marks: DataFrame) -> DataFrame:
        marks = marks.toDF(i, h, n)
        same = docs[id_col].eqNullSafe(marks[i]) & (F.xxhash64(docs[text_col]) == marks[h])
        return docs.join(marks, same, "left_semi")

    single = picked(chosen.where("n = 1"))
    if chosen.where("n > 1").isEmpty():
        return single
    return single.unionByName(picked(chosen.where("n > 1")).dropDuplicates([id_col, text_col]))

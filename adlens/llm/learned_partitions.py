"""Nearest vectors by inner product through learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts. A small network learns
to name a vector's part, and with it every row is filed. A second one learns in which
parts the neighbours of a vector lie; a query goes to its most probable parts, as many
as held-out sample vectors need for the wanted recall, and all rows found there are
ranked by the exact measure.

Equal vectors are searched for once, and of equal vectors only as many rows as an answer
can hold are filed, so copies cost nothing. Parts next to each other share a shelf, which
answers a query once for all of them. Large shelves are cut into chunks, and the queries
of a shelf into blocks, so a task holds a bounded piece of both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.session import cut_lineage

#: distinct vectors the partition is learnt from, at most, and their bytes
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
#: rows wanted in a part; parts, at most; sample vectors a part needs at least
PART_ROWS, MOST_PARTS, LEAST_SAMPLE = 1024, 256, 64
#: share of a held-out vector's neighbours in the sample that its parts must hold, on average
TARGET = 0.94
#: parts share a shelf of about so many rows; a task ranks a shelf, or a chunk of a large one, for a block of queries
SHELF_ROWS, QUERY_BLOCK = 16_384, 1024
#: bytes of a shelf's vectors as doubles; long vectors make shelves of fewer rows
SHELF_BYTES = 32 << 20
#: a part may be larger than the mean by this factor
SLACK = 1.1
HIDDEN, BATCH, STEPS, HELD_OUT = 128, 256, 2000, 8


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest inner products of every vector, itself excluded."""
    k = min(k, len(vectors) - 1)
    found = np.empty((len(vectors), k), np.int64)
    for a in range(0, len(vectors), 1024):
        near = vectors[a : a + 1024] @ vectors.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        found[a : a + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return found


def _halves(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts by repeated cuts at the median of the widest direction."""
    part = np.zeros(len(vectors), np.int64)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            inside = np.flatnonzero(part == p)
            centred = vectors[inside] - vectors[inside].mean(axis=0)
            along = centred @ np.linalg.svd(centred.T @ centred)[0][:, 0]
            upper = np.argsort(along, kind="stable")[len(inside) // 2 :]
            part[inside[upper]] += 1 << level
    return part


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12) -> np.ndarray:
    """A part per vector that few edges of the graph leave; no part is over ``SLACK`` times the mean.

    From equal parts, vectors move to the part of most of their neighbours, largest gain
    first, while the part has room. Half of them may move in a sweep, so that
    neighbours do not change places for ever.
    """
    n = len(vectors)
    part = _halves(vectors, parts)
    room = math.ceil(SLACK * n / parts)
    one, other = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    one, other = np.concatenate([one, other]), np.concatenate([other, one])
    for sweep in range(sweeps):
        near = np.bincount(one * parts + part[other], minlength=n * parts).reshape(n, parts)
        goal = near.argmax(axis=1)
        gain = near[np.arange(n), goal] - near[np.arange(n), part]
        may = np.flatnonzero((gain > 0) & (np.random.default_rng(sweep).random(n) < 0.5))
        may = may[np.lexsort((-gain[may], goal[may]))]
        first = np.searchsorted(goal[may], goal[may])
        free = room - np.bincount(part, minlength=parts)
        moved = may[np.arange(len(may)) - first < free[goal[may]]]
        if not len(moved) and sweep % 2:
            break
        part[moved] = goal[moved]
    return part


def shelf_rows(dims: int) -> int:
    return max(1, min(SHELF_ROWS, SHELF_BYTES // (8 * dims)))


class Network:
    """One hidden layer and a probability per part; learnt from shares of parts."""

    def __init__(self, vectors: np.ndarray, shares: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        d, parts = vectors.shape[1], shares.shape[1]
        self.scale = float(np.sqrt(np.mean(vectors.astype(np.float64) ** 2)) or 1.0)
        self.weights = [
            rng.normal(scale=math.sqrt(2 / d), size=(d, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
            rng.normal(scale=math.sqrt(1 / HIDDEN), size=(HIDDEN, parts)).astype(np.float32), np.zeros(parts, np.float32),
        ]
        mean, spread = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(vectors), BATCH)
            x = (vectors[at] / self.scale).astype(np.float32)
            w, b, v, c = self.weights
            hidden = np.maximum(x @ w + b, 0)
            off = (_softmax(hidden @ v + c) - shares[at]) / len(at)
            back = (off @ v.T) * (hidden > 0)
            rate = 0.01 * (1 - step / (STEPS + 1))
            for i, g in enumerate([x.T @ back, back.sum(axis=0), hidden.T @ off, off.sum(axis=0)]):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                spread[i] = 0.999 * spread[i] + 0.001 * g * g
                self.weights[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(spread[i] / (1 - 0.999**step)) + 1e-8)

    def chances(self, vectors: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return _softmax(np.maximum((vectors / self.scale).astype(np.float32) @ w + b, 0) @ v + c)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return (e / e.sum(axis=1, keepdims=True)).astype(np.float32)


class Router:
    """Files vectors under parts and names the parts a query has to look into."""

    def __init__(self, sample: np.ndarray, rows: int, k: int):
        wanted = min(MOST_PARTS, len(sample) // LEAST_SAMPLE, math.ceil(2 * rows / PART_ROWS))
        self.parts = 1 << max(0, wanted.bit_length() - 1)
        # the first cuts are the low bits of a part, so parts that share them lie together
        self.shelves = min(self.parts, 1 << max(0, math.ceil(math.log2(max(1, rows) / shelf_rows(sample.shape[1])))))
        self.probes = 1
        if self.parts == 1:
            return
        vectors = sample.astype(np.float32)
        graph = neighbour_graph(vectors, k)
        part = balanced_parts(vectors, graph, self.parts)
        self.file = Network(vectors, np.eye(self.parts, dtype=np.float32)[part], 1)
        filed = self.part_of(vectors)
        held_out = np.random.default_rng(3).permutation(len(vectors)) < len(vectors) // HELD_OUT
        shares = np.zeros((len(vectors), self.parts), np.float32)
        np.add.at(shares, (np.arange(len(vectors))[:, None], filed[graph]), 1 / graph.shape[1])
        self.route = Network(vectors[~held_out], shares[~held_out], 2)
        order = self._order(vectors[held_out])
        reached = np.cumsum(np.take_along_axis(shares[held_out], order, axis=1), axis=1).mean(axis=0)
        self.probes = int(np.searchsorted(reached, min(TARGET, reached[-1]) - 1e-6)) + 1

    def part_of(self, vectors: np.ndarray) -> np.ndarray:
        return self.file.chances(vectors).argmax(axis=1) if self.parts > 1 else np.zeros(len(vectors), np.int64)

    def _order(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-self.route.chances(vectors), axis=1, kind="stable")

    def parts_for(self, vectors: np.ndarray) -> np.ndarray:
        return self._order(vectors)[:, : self.probes] if self.parts > 1 else np.zeros((len(vectors), 1), np.int64)


def _matrix(column, dims: int) -> np.ndarray:
    """An Arrow column of lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _filed(rows: DataFrame, router, dims: int) -> DataFrame:
    """Rows with the ``part`` they lie in and its ``shelf``."""

    def run(batches):
        known = router.value
        for batch in batches:
            part = np.concatenate([known.part_of(_matrix(batch.column("v").slice(a, 4096), dims)) for a in range(0, max(1, batch.num_rows), 4096)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array((part % known.shelves).astype(np.int32))],
                                             [*batch.schema.names, "part", "shelf"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, part int, shelf int")


def _routed(queries: DataFrame, router, dims: int) -> DataFrame:
    """A row per query and ``shelf`` with the ``parts`` of it to look into."""

    def run(batches):
        known = router.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                parts = known.parts_for(_matrix(piece.column("v"), dims))
                key = (np.arange(len(parts))[:, None] * known.shelves + parts % known.shelves).ravel()
                order = np.argsort(key, kind="stable")
                key, first = np.unique(key[order], return_index=True)
                lists = pa.ListArray.from_arrays(np.append(first, len(order)).astype(np.int32), pa.array(parts.ravel()[order].astype(np.int32)))
                taken = pa.array(key // known.shelves)
                yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in piece.columns), lists, pa.array((key % known.shelves).astype(np.int32))],
                                                 [*piece.schema.names, "parts", "shelf"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInArrow(run, f"{schema}, parts array<int>, shelf int")


def _rank_cell(dims: int, k: int):
    """Function over the queries and rows of one cell: the ``k`` best rows of each query in its parts."""

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        q, x = _matrix(queries["v"], dims), _matrix(rows["v"], dims)
        part = rows["part"].to_numpy()
        asked = queries["parts"].combine_chunks()
        asking = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy()))
        parts = asked.flatten().to_numpy()
        one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in np.unique(part):
            who, a, b = asking[parts == p], *np.searchsorted(part, [p, p + 1])
            if not len(who):
                continue
            near = q[who] @ x[a:b].T
            # the product rounds by place: what could still tie is ranked by sums in a fixed order
            noise = 1e-12 * np.linalg.norm(q[who], axis=1) * np.linalg.norm(x[a:b], axis=1).max()
            least = np.partition(near, -k, axis=1)[:, -k] - noise if b - a > k else np.full(len(who), -np.inf)
            i, j = np.nonzero(near >= least[:, None])
            one.append(who[i])
            other.append(j + a)
        one, other = np.concatenate(one), np.concatenate(other)
        score = np.empty(len(one))
        for a in range(0, len(one), 65_536):
            score[a : a + 65_536] = np.cumsum(q[one[a : a + 65_536]] * x[other[a : a + 65_536]], axis=1)[:, -1]
        ids = rows["vec_id"].fill_null(0).to_numpy()
        no_id = rows["vec_id"].is_null().to_numpy()
        order = np.lexsort((rows["row"].to_numpy()[other], ids[other], no_id[other], -score, one))
        one, other, score = one[order], other[order], score[order]
        first = np.arange(len(one)) - np.searchsorted(one, one) < k
        other = pa.array(other[first])
        return pa.table({"cls": queries["cls"].take(pa.array(one[first])), "vec_id": rows["vec_id"].take(other),
                         "row": rows["row"].take(other), "score": pa.array(score[first])})

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` rows nearest to each query found, itself excluded.

    ``is_query`` is a condition on the columns of ``vectors``; NULL is no. Nearness is the
    inner product, summed in doubles in the order of the components; ties go to
    the smaller id, NULL last. Vectors that are NULL, empty, zero or hold NULL or non-finite
    components take no part, nor do those of another length than most (the shorter
    one on a tie). Every row counts: a copy of the query under the same id is found like
    any other. Other columns are not looked at but by ``is_query``. Empty tables give an
    empty table. The ids must be whole numbers.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    given = vectors.where(_usable(v)).select(
        F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")
    )
    given = cut_lineage(given.withColumn("row", F.monotonically_increasing_id()))
    result = "query_id bigint, rank int, vec_id bigint, score double"
    usual = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return spark.createDataFrame([], result)
    dims = usual.n
    given = given.where(F.size("v") == dims)

    # equal vectors are one class; of each only the rows that an answer can hold are filed
    classes = cut_lineage(given.groupBy("v").agg(F.min("row").alias("cls"), F.max("asked").alias("asked")))
    in_order = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "row")
    kept = given.select("vec_id", "row", "v").withColumn("r", F.row_number().over(in_order)).where(F.col("r") <= k + 1).drop("r")

    distinct = classes.count()
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    share = math.ceil(1_000_000 * min(1.0, 1.1 * bound / distinct))
    chosen = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < share).select("cls", "v").limit(bound).toArrow()
    sample = _matrix(chosen["v"], dims)[np.argsort(chosen["cls"].to_numpy())]
    router = spark.sparkContext.broadcast(Router(sample, distinct, k))

    rows = cut_lineage(_filed(kept, router, dims))
    queries = cut_lineage(_routed(classes.where("asked").select("cls", "v"), router, dims))
    # one row per shelf
    cut = rows.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / (2 * shelf_rows(dims))).cast("int").alias("chunks")).join(
        queries.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks")), "shelf"
    )
    cut = F.broadcast(cut)
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    dealt_rows = rows.join(cut, "shelf").withColumn("chunk", deal("row", "chunks")).withColumn("block", F.explode(numbers("blocks")))
    dealt_queries = queries.join(cut, "shelf").withColumn("block", deal("cls", "blocks")).withColumn("chunk", F.explode(numbers("chunks")))
    cell = ["shelf", "chunk", "block"]
    found = dealt_queries.select(*cell, "cls", "v", "parts").groupBy(*cell).cogroup(
        dealt_rows.select(*cell, "vec_id", "row", "v", "part").groupBy(*cell)
    ).applyInArrow(_rank_cell(dims, k + 1), "cls bigint, vec_id bigint, row bigint, score double")

    best_first = Window.partitionBy("cls").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = found.withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= k + 1)
    answers = best.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "row", "score"))).alias("best"))
    asked = given.where("asked").join(classes.select("v", "cls"), "v").select("cls", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    others = F.slice(F.filter("best", lambda b: b["row"] != F.col("own")), 1, k)
    listed = asked.join(answers, "cls").select("query_id", F.posexplode(others).alias("at", "b"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))

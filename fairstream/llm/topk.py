"""Exact top-k by inner product with a pivot-distance index.

One more coordinate gives all vectors the same norm M, so that the largest inner product with a
query is the smallest distance. The index keys each vector by its nearest pivot and its distance
to it, cut into rings of equal width. A query first searches the rings around its own place,
nearest first, then only the rings that the triangle inequality cannot rule out at the k-th
score found so far. Rings are cut into chunks of bounded size, and queries meet them in batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairstream.llm.lattice import usable
from fairstream.plans.storage import cut, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTOR = 256
PIVOTS = 16
SAMPLE = 512
CHUNK = 2048
QUERIES_A_SALT = 20_000
BATCH = 512
SLACK = 1e-6
BROADCAST_ROWS = 100_000
NOTHING = -(2**63)
EXACT = float(2**53)


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(FACTOR)) * x.cast("double")).cast("bigint"))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    picks = [0]
    nearest = ((points - points[0]) ** 2).sum(1)
    while len(picks) < min(count, len(points)) and nearest.max() > 0:
        picks.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[picks[-1]]) ** 2).sum(1))
    return points[picks]


def _lifted(v: np.ndarray, square: float, query: bool = False) -> np.ndarray:
    """The added coordinate makes all squared norms ``square``; a query has zero there."""
    v = v.astype(np.float64)
    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, square - (v * v).sum(1)))
    return np.concatenate([v, last[:, None]], axis=1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(0.0, squares))


class Index:
    """One bounded object per length of vectors: pivots and what is needed to place by them."""

    def __init__(self, rows: DataFrame, dims: int, count: int):
        self.dims = dims
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        self.square = float(rows.agg(F.max(norm)).head()[0]) * (1 + 1e-12)
        # a fixed number of vectors by hash: they only choose the pivots
        sample = rows.orderBy(F.xxhash64("v"), "v").select("v").limit(SAMPLE).collect()
        points = _lifted(np.array([r.v for r in sample], np.int64).reshape(-1, dims), self.square)
        self.pivots = _farthest_first(points, PIVOTS)
        # rings as wide as hold a chunk if the vectors were spread evenly over pivots and distances
        spread = _distances(points, self.pivots).min(1)
        rings = max(1, -(-count // (CHUNK * len(self.pivots))))
        self.width = max(1.0, float(np.ptp(spread)) / rings)

    def slots(self, distance: np.ndarray) -> np.ndarray:
        return np.floor(distance / self.width).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _top_of_block(query_ids: np.ndarray, queries: np.ndarray, id_lists: list[np.ndarray], vectors: np.ndarray, k: int):
    """``query, id, score`` of the best k of a block for each query, without the query's own row."""
    scores = products(queries, vectors)
    out_q, out_i, out_s = [], [], []
    # the k + 1 best vectors hold the k best rows beside the query's; ties with the last stay in
    keep = min(k + 1, scores.shape[1])
    edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
    for row in range(len(queries)):
        at = np.flatnonzero(scores[row] >= edge[row])
        ids = np.concatenate([id_lists[j] for j in at])
        score = np.repeat(scores[row, at], [len(id_lists[j]) for j in at])
        other = ids != query_ids[row]
        ids, score = ids[other], score[other]
        best = _best(ids, score, k)
        out_q.append(np.full(len(best), query_ids[row]))
        out_i.append(ids[best])
        out_s.append(score[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_i, out_s))


def _searcher(dims: int, k: int):
    """Rows sorted by ``pivot, slot, chunk, salt`` with the vectors of a key before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, stacked = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                rows = batch.slice(start, end - start)
                if tuple(keys[start, :4]) != key:
                    key, ids, vectors, stacked = tuple(keys[start, :4]), [], [], None
                if keys[start, 4] == 0:
                    ids += [np.array(x, np.int64) for x in rows.column(5).to_pylist()]
                    vectors.append(_matrix(rows.column(6), dims))
                    stacked = None
                    continue
                if not vectors:
                    continue
                stacked = np.concatenate(vectors) if stacked is None else stacked
                own = np.array([x[0] for x in rows.column(5).to_pylist()], np.int64)
                queries = _matrix(rows.column(6), dims)
                for low in range(0, len(own), BATCH):
                    found = _top_of_block(own[low : low + BATCH], queries[low : low + BATCH], ids, stacked, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(visits: DataFrame, cells: DataFrame, chunks: DataFrame, salts: int, dims: int, k: int) -> DataFrame:
    """``query_id, q, pivot, slot`` against the cells of the same place: the best k of each chunk."""
    few = chunks.count() <= BROADCAST_ROWS
    met = visits.join(F.broadcast(chunks) if few else chunks, ["pivot", "slot"])
    asked = met.select(
        "pivot", "slot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1).cast("array<bigint>")).alias("chunk"),
        F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("bigint").alias("salt"), F.lit(1).cast("bigint").alias("kind"),
        F.array("query_id").alias("ids"), F.col("q").alias("v"),
    )
    held = cells.select(
        "pivot", "slot", "chunk", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"),
        F.lit(0).cast("bigint").alias("kind"), "ids", "v",
    )
    place = ["pivot", "slot", "chunk", "salt"]
    both = held.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "kind")
    return both.mapInArrow(_searcher(dims, k), "query_id bigint, vec_id bigint, score bigint")


def _top_of_length(rows: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    # equal vectors are one entry; of its ids only the k + 1 smallest can be in an answer
    smallest = Window.partitionBy("v").orderBy("vec_id")
    numbered = rows.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
    entries = stored(numbered.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "topk-entries")
    count = entries.count()
    index = Index(entries, dims, count)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = _distances(_lifted(_matrix(batch.column(1), dims), index.square), index.pivots)
            pivot = distance.argmin(1)
            slot = index.slots(distance[np.arange(len(pivot)), pivot])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(slot)], ["ids", "v", "pivot", "slot"])

    placed = stored(entries.select("ids", "v").mapInArrow(place, "ids array<bigint>, v array<bigint>, pivot bigint, slot bigint"), "topk-index")
    sizes = placed.groupBy("pivot", "slot").count()
    chunks = cut(sizes.select("pivot", "slot", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    few = chunks.count() <= BROADCAST_ROWS
    cells = placed.join(F.broadcast(chunks) if few else chunks, ["pivot", "slot"])
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("bigint")).drop("chunks")
    salts = max(1, -(-queries.count() // QUERIES_A_SALT))
    ends = {r.pivot: (r.low, r.high) for r in chunks.groupBy("pivot").agg(F.min("slot").alias("low"), F.max("slot").alias("high")).collect()}

    def visits(first: bool):
        """Rings a query has to look at: those next to its place, or all others that may matter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column(1), dims)
                lifted = _lifted(q, index.square, query=True)
                distance = _distances(lifted, index.pivots)
                # the best place of a query is where the vector of its direction and of norm M is
                norm = np.sqrt((lifted * lifted).sum(1, keepdims=True))
                ahead = _distances(lifted * np.sqrt(index.square) / np.where(norm == 0, 1.0, norm), index.pivots)
                own = np.argsort(ahead, axis=1)[:, :2]
                tau = batch.column(2).to_numpy(zero_copy_only=False)
                out = ([], [], [])
                for row in range(len(q)):
                    near = set()
                    for p in own[row].tolist():
                        if p in ends:
                            low, high = ends[p]
                            mid = int(np.clip(index.slots(ahead[row, p : p + 1])[0], low, high))
                            near |= {(p, s) for s in (mid - 1, mid, mid + 1) if low <= s <= high}
                    if first:
                        places = near
                    else:
                        places = set()
                        reach = np.inf
                        if tau[row] != NOTHING:
                            square = float(norm[row, 0]) ** 2 + index.square - 2.0 * float(tau[row])
                            reach = np.sqrt(max(0.0, square)) * (1 + SLACK) + SLACK * (1 + np.sqrt(index.square))
                        for p, (low, high) in ends.items():
                            d = distance[row, p]
                            if np.isfinite(reach):
                                low = max(low, int(np.floor((d - reach) / index.width)))
                                high = min(high, int(np.floor((d + reach) / index.width)))
                            places |= {(p, s) for s in range(low, high + 1)}
                        places -= near
                    out[0].extend([row] * len(places))
                    out[1].extend(p for p, _ in places)
                    out[2].extend(s for _, s in places)
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                    ["query_id", "q", "pivot", "slot"],
                )

        return run

    schema = "query_id bigint, q array<bigint>, pivot bigint, slot bigint"
    asking = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    start = asking.withColumn("tau", F.lit(NOTHING).cast("bigint"))
    near = stored(_top(_search(start.mapInArrow(visits(True), schema), cells, chunks, salts, dims, k), k), "topk-near")
    reached = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("tau"))
    bounded = asking.join(reached, "query_id", "left").select("query_id", "q", F.coalesce("tau", F.lit(NOTHING).cast("bigint")).alias("tau"))
    rest = _search(bounded.mapInArrow(visits(False), schema), cells, chunks, salts, dims, k)
    return _top(near.drop("rank").unionByName(rest), k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``vec_id, embedding`` -> ``query_id, rank int, vec_id, score``: the k best rows of each query.

    Components become ``floor(256 * x)``; the score is the integer inner product. Candidates are all
    rows but the query's own; ties go to the smaller id. Vectors that are null, hold a null or
    non-finite component, or have no id take no part, and vectors of different length have no
    product. Rows that repeat an id and its vector are one row. With fewer than k candidates
    all are returned. An empty table, or one without queries, gives an empty result.
    """
    ok = F.coalesce(usable(F.col("embedding")), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.filter(ok).select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v"), is_query.alias("asks"))
    rows = stored(rows.dropDuplicates(["vec_id", "v"]), "topk-rows")
    parts = []
    for r in rows.filter("asks").groupBy(F.size("v").alias("dims")).count().collect():
        if r.dims:
            same = rows.filter(F.size("v") == r.dims)
            parts.append(_top_of_length(same.select("vec_id", "v"), same.filter("asks").select("vec_id", "v"), r.dims, k))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Connected components of a link table, with labels only ever held by Spark."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairstream.plans.storage import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: So many links fit one task, some 20 MB.
FINISH_LINKS = 100_000


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Places of those links of one bounded group that already connect all that it connects."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a bounded table of links ``a, b`` -> ``node, root``, the smallest node of each component."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    columns = [pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["node", "root"])


def components(links: DataFrame, finish_links: int = FINISH_LINKS) -> DataFrame:
    """``a bigint, b bigint`` -> ``node, root``: the smallest node reachable, for every node of a link.

    Links to oneself, repeated links and both directions may occur; links with a null end are
    left out. Each round lets every node go to the first of its neighbours in a random order (a
    hash of the round) if that comes before it, and to where that one goes; then both ends of the
    links are renamed, and links inside one node and repeated ones vanish. So the links shrink by
    a constant share each round, whatever their shape, and no later round sees the first table.
    Once ``finish_links`` or fewer are left, one task has room for them and solves the rest. Inputs
    of the joins are checkpoints, so Spark can split the rows of a node with very many links.
    """
    ends = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b")
    ends = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while ends.count() > finish_links:
        turned = [F.struct(F.xxhash64(F.lit(turn), c).alias("at"), F.col(c).alias("node")) for c in ("a", "b")]
        both = ends.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.least(*turned).alias("first")) for c in ("a", "b")))).alias("s"))
        step = cut(both.groupBy("s.node").agg(F.min("s.first")["node"].alias("next")))
        beyond = step.select(F.col("node").alias("next"), F.col("next").alias("last"))
        moved = cut(step.join(beyond, "next").select("node", F.col("last").alias("root")))
        labels = moved if labels is None else _renamed(labels, moved)
        for c in ("a", "b"):
            ends = ends.join(moved.select(F.col("node").alias(c), "root"), c).drop(c).withColumnRenamed("root", c)
        ends = ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        ends, turn = cut(ends.distinct()), turn + 1
    rest = ends.repartition(1).mapInArrow(_solved, "node bigint, root bigint")
    if labels is None:
        return cut(rest)
    labels = _renamed(labels, cut(rest))
    lowest = labels.groupBy("root").agg(F.min("node").alias("lowest"))
    return cut(labels.join(lowest, "root").select("node", F.col("lowest").alias("root")))


def _renamed(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """``labels`` with each root where ``moved`` takes it."""
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return cut(labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))

"""A Merkle manifest of a dataset, and proofs by descent through its records.

Leaves are digests of rows, in order inside their group; every run of ``ARITY`` nodes becomes one
node until a group has a single one, its subroot. The subroots, in order of their groups, become the
root in the same way. ``STEPS`` levels at a time are worked out in one task and stored as one
segment: the record of each inner node, digest to children, under the digest of the segment's top.

A proof needs no index but these records. Requests for leaves descend from the root: the digits
of a leaf's rank say which child is taken, the others are collected, and the path is reversed at the
end. Requests share their way: a step looks up each segment once by its digest, and what lies
below goes on together, so only the last step has as many rows as there are requests.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairstream.plans.storage import cut, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARITY, STEPS = 2, 8
WIDTH = ARITY**STEPS
BROADCAST_ROWS = 100_000
SPREAD = 256
NODES = "array<struct<digest:binary,children:array<binary>>>"
#: One step of a proof: the digests of the run's other nodes before and after the own one.
PROOF = "array<struct<before:string,after:string>>"
PATH = "array<struct<before:binary,after:binary>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, values)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.concat(step["before"], own, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings from the leaf's level upward, left to right."""
    steps = F.transform(proof, lambda step: F.concat(step["before"], step["after"]))
    return F.sha2(F.array_join(steps, ""), 256)


def ranked(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``at``, their place from zero in their group, and the table ``group, n``.

    Nulls come first. One range exchange sorts all groups at once, so a group may be of any size;
    rows equal in all of ``order`` are dealt over tasks by their place in the input. The places
    follow from counts by group and task.
    """
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("spread")
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "spread")]
    dealt = rows.select("*", spread).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = stored(dealt.drop("spread").withColumn("place", F.monotonically_increasing_id()), "manifest-ranked")
    held = held.withColumn("task", F.shiftright("place", 33))
    counts = cut(held.groupBy(group, "task").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("own_group"), F.col("task").alias("own_task"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    small = F.broadcast(starts) if counts.count() <= BROADCAST_ROWS else starts
    placed = held.join(small, held[group].eqNullSafe(F.col("own_group")) & (F.col("task") == F.col("own_task")))
    at = (F.col("place") - F.col("first") + F.col("before")).alias("at")
    return placed.select(*rows.columns, at), counts.groupBy(group).agg(F.sum("n").alias("n"))


def _levels(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _segment(digests: list[bytes], levels: int) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """The top over a row of nodes and the record of each node between."""
    records: list[tuple[bytes, list[bytes]]] = []
    for _ in range(levels):
        runs = [digests[i : i + ARITY] for i in range(0, len(digests), ARITY)]
        digests = [hashlib.sha256(b"".join(d.hex().encode() for d in run)).digest() for run in runs]
        records += zip(digests, runs)
    return digests[0], records


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``grp, seg, at, n, digest`` -> one row a segment."""
    schema = pa.schema(
        [("grp", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]
        + [("nodes", pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))])))]
    )
    key, n, row = None, 0, []
    for batch in batches:
        made = []
        for grp, seg, _, count, digest in zip(*(c.to_pylist() for c in batch.columns)):
            if (grp, seg) != key:
                if row:
                    made.append((*key, -(-n // WIDTH), *_segment(row, min(STEPS, _levels(n)))))
                key, n, row = (grp, seg), count, []
            row.append(digest)
        yield _table(made, schema)
    if row:
        yield _table([(*key, -(-n // WIDTH), *_segment(row, min(STEPS, _levels(n))))], schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    named = [dict(zip(schema.names, r)) for r in rows]
    for r in named:
        r["nodes"] = [{"digest": d, "children": c} for d, c in r["nodes"]]
    return pa.RecordBatch.from_pylist(named, schema)


def _tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``grp, at, n, digest`` -> the segments of each storey from below, and ``grp, digest`` of the tops."""
    storeys, tops = [], None
    widest = nodes.agg(F.max("n")).head()[0] or 0
    while True:
        done = nodes.filter("n = 1").select("grp", "digest")
        tops = done if tops is None else tops.unionByName(done)
        if widest <= 1:
            return storeys, tops
        rows = nodes.filter("n > 1").select("grp", F.floor(F.col("at") / WIDTH).alias("seg"), "at", "n", "digest")
        dealt = rows.repartition("grp", "seg").sortWithinPartitions("grp", "seg", "at")
        made = dealt.mapInArrow(_built, f"grp bigint, at bigint, n bigint, digest binary, nodes {NODES}")
        storeys.append(stored(made, "manifest-segments"))
        nodes, widest = storeys[-1].select("grp", "at", "n", "digest"), -(-widest // WIDTH)


@dataclass
class Manifest:
    """Segments by storey (lower ones first, the groups' before the root's), leaves and roots."""

    storeys: list[DataFrame]
    group_storeys: int
    leaves: DataFrame  # all columns of the leaves given, and grp, at
    groups: DataFrame  # group, grp, subroot
    root: str | None


def manifest(leaves: DataFrame, group: str, *order: str) -> Manifest:
    """The manifest of ``leaves`` (which have a column ``leaf``), in order of ``order`` in each group."""
    placed, sizes = ranked(stored(leaves, "manifest-leaves"), group, *order)  # a range exchange reads its input twice
    named = sizes.select(group, "n", (F.col("n") - F.col("n")).alias("one"))  # one group of all, not folded into a constant
    numbered, _ = ranked(named, "one", group)
    numbered = cut(numbered.select(F.col(group).alias("own_group"), F.col("at").alias("grp"), "n"))
    groups = numbered.count()
    small = F.broadcast(numbered) if groups <= BROADCAST_ROWS else numbered
    placed = placed.join(small, placed[group].eqNullSafe(F.col("own_group"))).drop("own_group")
    storeys, tops = _tree(placed.select("grp", "at", "n", F.unhex("leaf").alias("digest")))
    tops = cut(tops)
    above, root = _tree(tops.select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("at"), F.lit(groups).cast("bigint").alias("n"), "digest"))
    found = root.select(F.lower(F.hex("digest"))).head()
    named = numbered.join(tops, "grp").select(F.col("own_group").alias(group), "grp", F.lower(F.hex("digest")).alias("subroot"))
    return Manifest(storeys + above, len(storeys), placed.drop("n"), named, found[0] if found else None)


def _digits(at: int, levels: int) -> list[int]:
    """Which child is taken on each level from the top."""
    return [at // ARITY**k % ARITY for k in reversed(range(levels))]


def _walk(top: bytes, children: dict[bytes, list[bytes]], at: int, levels: int) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """Down from ``top`` by the digits of ``at``: the node reached, and the others on the way, from the top."""
    path = []
    for digit in _digits(at, levels):
        run = children[top]
        path.append((b"".join(run[:digit]), b"".join(run[digit + 1 :])))
        top = run[digit]
    return top, path


def _depth(top: bytes, children: dict[bytes, list[bytes]]) -> int:
    depth = 0
    while top in children:
        top, depth = children[top][0], depth + 1
    return depth


def _below(top: bytes, children: dict[bytes, list[bytes]]) -> int:
    """How many nodes the lowest level of a segment has."""
    row = [top]
    while row[0] in children:
        row = [c for d in row for c in children[d]]
    return len(row)


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``grp, at, digest, nodes, path`` -> the same for all nodes below each segment."""
    step = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
    schema = pa.schema([("grp", pa.int64()), ("at", pa.int64()), ("digest", pa.binary()), ("path", step)])
    for batch in batches:
        for row in batch.to_pylist():
            if row["nodes"] is None:  # a lower tree whose top this is
                out = [(row["at"], row["digest"], [])]
            else:
                children = {r["digest"]: r["children"] for r in row["nodes"]}
                depth = _depth(row["digest"], children)
                walks = [_walk(row["digest"], children, i, depth) for i in range(_below(row["digest"], children))]
                out = [(row["at"] * WIDTH + i, digest, path) for i, (digest, path) in enumerate(walks)]
            made = [
                {"grp": row["grp"], "at": at, "digest": digest, "path": row["path"] + [{"before": b, "after": a} for b, a in path]}
                for at, digest, path in out
            ]
            yield pa.RecordBatch.from_pylist(made, schema)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``digest, nodes, path, asked`` -> one row for each leaf asked for, its path reversed."""
    step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    for batch in batches:
        digests, nodes, paths = (c.to_pylist() for c in batch.columns[:3])
        asked = batch.column(3)
        rows, leaves, proofs = [], [], []
        places = pa.compute.list_flatten(asked).field("at").to_pylist()
        ends = asked.value_lengths().to_pylist()
        start = 0
        for top, records, path, n in zip(digests, nodes, paths, ends):
            children = {r["digest"]: r["children"] for r in records or ()}
            depth = _depth(top, children)
            for at in places[start : start + n]:
                leaf, own = _walk(top, children, at % WIDTH, depth)
                whole = [(p["before"], p["after"]) for p in path] + own
                leaves.append(leaf.hex())
                proofs.append([{"before": b.hex(), "after": a.hex()} for b, a in reversed(whole)])
            start += n
        rows = pa.compute.list_flatten(asked).field("row")
        yield pa.RecordBatch.from_arrays([rows, pa.array(leaves, pa.string()), pa.array(proofs, step)], ["row", "leaf", "proof"])


def proofs(made: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (leaves of the manifest by ``grp, at``; any columns) with ``leaf`` and ``proof`` from the records.

    ``proof`` goes from the leaf's level to the root. Columns of ``requests`` named ``leaf`` or
    ``proof`` are replaced.
    """
    if made.root is None:
        return requests.drop("leaf", "proof").select("*", F.lit(None).cast("string").alias("leaf"), F.lit(None).cast(PROOF).alias("proof"))
    spark = requests.sparkSession
    root = F.unhex(F.lit(made.root))
    frontier = spark.range(1).select(F.lit(0).cast("bigint").alias("grp"), F.lit(0).cast("bigint").alias("at"), root.alias("digest"), F.array().cast(PATH).alias("path"))

    def met(frontier: DataFrame, storey: int) -> DataFrame:
        records = made.storeys[storey].select("digest", "nodes").dropDuplicates(["digest"])
        return frontier.join(records, "digest", "left").select("grp", "at", "digest", "nodes", "path")

    below = f"grp bigint, at bigint, digest binary, path {PATH}"
    for storey in reversed(range(made.group_storeys, len(made.storeys))):
        frontier = met(frontier, storey).mapInArrow(_descended, below)
    # below the root's tree each node is the top of a group's
    frontier = cut(frontier.select(F.col("at").alias("grp"), F.lit(0).cast("bigint").alias("at"), "digest", "path"))
    for storey in reversed(range(1, made.group_storeys)):
        wanted = requests.select("grp", F.floor(F.col("at") / WIDTH**storey).alias("at")).distinct()
        frontier = met(frontier, storey).mapInArrow(_descended, below).join(wanted, ["grp", "at"], "left_semi")
    reached = met(frontier, 0) if made.group_storeys else frontier.withColumn("nodes", F.lit(None).cast(NODES))
    own = [c for c in requests.columns if c not in ("leaf", "proof")]
    asked = requests.select("grp", F.floor(F.col("at") / WIDTH).alias("seg"), F.struct(F.col("at"), F.struct(*own).alias("row")).alias("one"))
    asked = asked.groupBy("grp", "seg").agg(F.collect_list("one").alias("asked"))
    joined = reached.join(asked, (reached["grp"] == asked["grp"]) & (reached["at"] == asked["seg"])).select("digest", "nodes", "path", "asked")
    row = asked.schema["asked"].dataType.elementType["row"].dataType.simpleString()
    return joined.mapInArrow(_answered, f"row {row}, leaf string, proof {PROOF}").select("row.*", "leaf", "proof")

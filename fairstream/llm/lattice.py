"""Embedding near-duplicates by hashing to the E8 lattice.

Equal vectors of a label are one class. In every table a random projection of the direction
to 8 x ``PARTS`` coordinates is decoded, eight at a time, to the nearest E8 point; the points make
a cell. A vector lives in its home cell and also visits the cells with one of the points
exchanged for the next nearest. Vectors that meet are compared by cosine in double precision.

A pair counts in the first table, and there in the one cell, where it can meet, so links are
counted without a list of pairs.

Where cells are crowded, balls come first. Their centers are found in a bounded sample of each
crowded cell; a vector of the label belongs to the first ball whose center is within half the angle
of a link. Angles are a metric, so all of a ball are links of each other, whatever their number: they
are counted by one sum a ball and never meet in a cell. What is left of a crowded cell is compared in blocks by
many tasks, but for balls that the triangle inequality keeps too far apart.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairstream.llm.graph import components, forest
from fairstream.plans.storage import cut, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COSINE = 0.98
TABLES = 4
PARTS = 2
SCALE = 0.9
SEED = 20
BLOCK = 1024
BROADCAST_ROWS = 100_000
#: Rows a crowded cell is sampled by, balls it may propose, and the least share of a sample in a ball.
SAMPLE, PROPOSED, LEAST_SHARE = 256, 8, 1 / 32
#: Balls in all, those of the most rows; vectors of no ball are compared in blocks.
BALLS = 1024
LINK = float(np.arccos(COSINE))
#: Cosine with the center inside a ball, well on the safe side of rounding.
INSIDE = float(np.cos(LINK / 2 - 1e-6))
ROW = "label string, cell bigint, ball int, home boolean, at int, id bigint, copies bigint, keys binary, vector binary"
CLASS = "id bigint, label string, copies bigint, embedding array<double>, ball int"


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 = D8 and D8 + 1/2 to each row."""

    def nearest_d8(x: np.ndarray) -> np.ndarray:
        point = np.round(x)
        gap = x - point
        odd = np.flatnonzero(point.sum(1) % 2 != 0)
        worst = np.abs(gap[odd]).argmax(1)
        point[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
        return point

    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def next_e8(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The closest to ``x`` of the 240 neighbours of its nearest lattice point."""
    gap = x - point
    size, sign = np.abs(gap), np.where(gap >= 0, 1.0, -1.0)
    rows = np.arange(len(x))
    two = np.zeros_like(x)
    order = np.argsort(-size, axis=1, kind="stable")
    for j in (0, 1):
        two[rows, order[:, j]] = sign[rows, order[:, j]]
    halves = sign / 2
    odd = (sign < 0).sum(1) % 2 != 0  # an even number of minus signs
    halves[odd, order[odd, -1]] *= -1
    gain_two, gain_half = (two * gap).sum(1), (halves * gap).sum(1)
    return point + np.where((gain_two >= gain_half)[:, None], two, halves)


def cell_keys(unit: np.ndarray) -> np.ndarray:
    """Keys ``(rows, TABLES, 1 + PARTS)`` of the home cell and the visited ones."""
    dims = unit.shape[1]
    rng = np.random.default_rng([SEED, dims])
    keys = np.empty((len(unit), TABLES, 1 + PARTS), np.int64)
    for table in range(TABLES):
        projected = unit @ (rng.normal(size=(dims, 8 * PARTS)) / (np.sqrt(8) * SCALE))
        salt = rng.integers(1, 2**62, (PARTS, 8), dtype=np.int64) | 1
        home, other = [], []
        for part in range(PARTS):
            x = projected[:, 8 * part : 8 * part + 8]
            point = nearest_e8(x)
            for out, p in ((home, point), (other, next_e8(x, point))):
                mixed = ((2 * p).astype(np.int64) * salt[part]).sum(1)
                out.append((mixed ^ (mixed >> 29)) * np.int64(0x5851F42D4C957F2D))
        start = np.int64(table + 1) * np.int64(0x2545F4914F6CDD1D)
        keys[:, table, 0] = start + sum(home)
        for part in range(PARTS):
            keys[:, table, 1 + part] = keys[:, table, 0] - home[part] + other[part]
    return keys


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, in half the space where single precision holds them exactly."""
    short = x.astype(np.float32)
    kept = short if (short == x).all() else x
    return [row.tobytes() for row in kept]


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dims else np.float64) for r in rows], np.float64)


def _cells(with_vectors: bool):
    """Classes of ``CLASS`` -> rows of ``ROW``, or only ``label, cell, ball``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            values = batch.column(3).to_pylist()
            lengths = np.array([len(v) for v in values])
            for dims in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dims)
                for start in range(0, len(rows), 512):
                    part = rows[start : start + 512]
                    x = np.array([values[i] for i in part], np.float64)
                    keys = cell_keys(units(x))
                    n, each = len(part), TABLES * (1 + PARTS)
                    # vectors of different length never meet, as their label differs
                    label = batch.column(1).take(pa.array(np.repeat(part, each)))
                    ball = batch.column(4).take(pa.array(np.repeat(part, each)))
                    columns = [label, pa.array(keys.reshape(-1)), ball]
                    if with_vectors:
                        at = np.tile(np.repeat(np.arange(TABLES), 1 + PARTS), n)
                        home = np.tile(np.arange(1 + PARTS) == 0, n * TABLES)
                        own = [pa.array(m, pa.binary()).take(pa.array(np.repeat(np.arange(n), each))) for m in ([k.tobytes() for k in keys], packed(x))]
                        ids = [batch.column(c).take(pa.array(np.repeat(part, each))) for c in (0, 2)]
                        columns += [pa.array(home), pa.array(at.astype(np.int32)), *ids, *own]
                    names = [c.split()[0] for c in ROW.split(", ")][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _compare(at: np.ndarray, home: np.ndarray, side: np.ndarray, cell: int, ids: np.ndarray, ball: np.ndarray, keys: np.ndarray, unit: np.ndarray):
    """Links of one cell but those inside a ball: ends as positions. ``side`` is 0 in a block by itself, else 1 or 2."""
    if side.max() == 0:
        a, b = np.nonzero(np.triu(unit @ unit.T >= COSINE, 1))
    else:
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        a, b = np.nonzero(unit[one] @ unit[two].T >= COSINE)
        a, b = one[a], two[b]
    ok = (home[a] | home[b]) & (ids[a] != ids[b]) & ((ball[a] != ball[b]) | (ball[a] < 0))
    a, b = a[ok], b[ok]
    table = int(at[0])
    new = np.ones(len(a), bool)
    for t in range(table + 1):
        ha, hb = keys[a, t, 0], keys[b, t, 0]
        a_visits = (keys[a, t, 1:] == hb[:, None]).any(1)
        b_visits = (keys[b, t, 1:] == ha[:, None]).any(1)
        if t < table:
            new &= ~((ha == hb) | a_visits | b_visits)
        else:  # of two cells where each visits the other the smaller key counts
            new &= ~(a_visits & b_visits & (cell != np.minimum(ha, hb)))
    return a[new], b[new]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``label, cell, i, j`` -> ``a, null, n`` (n more links of a) and ``a, b, 0`` (a link).

    The links given are a forest of those found in a cell, enough for its components.
    """

    def group(rows: pa.Table) -> tuple | None:
        at = rows["at"].to_numpy()
        home = rows["home"].to_numpy(zero_copy_only=False)
        # the label begins with the length of its vectors
        unit = units(unpacked(rows["vector"].to_pylist(), int(rows["label"][0].as_py().split(":")[0])))
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.int64).reshape(len(at), TABLES, 1 + PARTS)
        ids, copies, side, ball = (rows[c].to_numpy() for c in ("id", "copies", "side", "ball"))
        cell = rows["cell"][0].as_py()
        a, b = _compare(at, home, side, cell, ids, ball, keys, unit)
        if not len(a):
            return None
        more = np.bincount(a, copies[b], len(at)) + np.bincount(b, copies[a], len(at))
        kept, some = forest(a, b, len(at)), np.flatnonzero(more)
        ends = np.r_[ids[some], ids[a[kept]]], np.r_[np.zeros(len(some), np.int64), ids[b[kept]]]
        return *ends, np.r_[more[some].astype(np.int64), np.zeros(len(kept), np.int64)], np.r_[np.ones(len(some), bool), np.zeros(len(kept), bool)]

    def results(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for start, end in zip(starts, [*starts[1:], rows.num_rows]):
            if end - start > 1 and (got := group(rows.slice(start, end - start))):
                found.append(got)
        if found:
            a, b, n, count = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=count), pa.array(n)], ["a", "b", "n"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        changed = np.zeros(rows.num_rows, bool)
        changed[0] = True
        for c in ("label", "cell", "i", "j"):
            column = rows[c].combine_chunks().dictionary_encode()
            codes = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).indices.to_numpy()
            changed[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(changed)
        # the last group may go on in the next batch; blocks bound its size
        yield from results(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1])
    if held is not None and held.num_rows:
        yield from results(held, np.array([0]))


def _proposed(key: tuple, rows: pa.Table) -> pa.Table:
    """Centers of balls for the sample of one crowded cell, with the rows of the cell each may hold."""
    label, size = key[0].as_py(), rows["count"][0].as_py()
    unit = units(unpacked(rows["vector"].to_pylist(), int(label.split(":")[0])))
    centers, weights, left = [], [], np.ones(len(unit), bool)
    around = (unit @ unit.T >= COSINE).astype(float) @ unit
    around /= np.sqrt((around * around).sum(1, keepdims=True))
    inside = around @ unit.T >= INSIDE
    while len(centers) < PROPOSED:
        held = (inside & left).sum(1)
        best = int(held.argmax())
        if held[best] < max(2, LEAST_SHARE * len(unit)):
            break
        centers.append(around[best].tobytes())
        weights.append(float(held[best] / len(unit) * size))
        left &= ~inside[best]
    return pa.table({"label": pa.array([label] * len(centers), pa.string()), "center": pa.array(centers, pa.binary()), "weight": pa.array(weights, pa.float64())})


def _centers(classes: DataFrame, crowded: DataFrame, cells: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Label -> numbers and centers of its balls; at most ``BALLS`` in all, the heaviest first."""
    rows = classes.mapInArrow(_cells(True), ROW).select("label", "cell", "id", "vector")
    met = rows.join(F.broadcast(crowded) if cells <= BROADCAST_ROWS else crowded, ["label", "cell"])
    # about SAMPLE rows a cell, by hash
    sample = met.filter(F.pmod(F.xxhash64("id", "cell"), F.lit(1 << 30)) < F.lit(SAMPLE * float(1 << 30)) / F.col("count"))
    proposed = sample.select("label", "cell", "count", "vector").groupBy("label", "cell").applyInArrow(_proposed, "label string, center binary, weight double")
    balls: dict[str, list] = {}
    number = 0
    # one crowd proposes much the same center in each of its cells
    for row in proposed.orderBy(F.desc("weight"), "label", "center").limit(4 * BALLS).collect():
        center, own = np.frombuffer(row.center), balls.setdefault(row.label, [])
        if number < BALLS and all(center @ other < np.cos(LINK / 4) for _, other in own):
            own.append((number, center))
            number += 1
    return {label: (np.array([n for n, _ in own]), np.array([c for _, c in own])) for label, own in balls.items() if own}


def _with_balls(balls: dict[str, tuple[np.ndarray, np.ndarray]]):
    """Classes with the number of the first ball each is in, else -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ball = batch.column(1).to_pylist(), np.full(batch.num_rows, -1, np.int32)
            for label in set(labels) & balls.keys():
                numbers, centers = balls[label]
                rows = np.flatnonzero([x == label for x in labels])
                unit = units(np.array(batch.column(3).take(pa.array(rows)).to_pylist(), np.float64))
                inside = unit @ centers.T >= INSIDE
                ball[rows] = np.where(inside.any(1), numbers[inside.argmax(1)], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ball)], ["id", "label", "copies", "embedding", "ball"])

    return run


def in_balls(classes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, dict[int, list[int]]]:
    """``id, label, copies, embedding`` -> rows of ``CLASS``, and for each ball those near enough for links.

    The cells are counted first; where none holds more than ``block`` vectors there are no balls.
    """
    plain = classes.withColumn("ball", F.lit(-1))
    sizes = plain.mapInArrow(_cells(False), "label string, cell bigint, ball int").groupBy("label", "cell").count()
    crowded = cut(sizes.filter(F.col("count") > block))
    cells = crowded.count()
    balls = _centers(plain, crowded, cells) if cells else {}
    if not balls:
        return plain, {}
    near = {}
    for numbers, centers in balls.values():
        # both radii are half a link
        close = centers @ centers.T >= np.cos(min(2 * LINK + 1e-6, np.pi))
        near.update({int(n): numbers[row].tolist() for n, row in zip(numbers, close)})
    return stored(classes.mapInArrow(_with_balls(balls), CLASS), "vector-balls"), near


def _placed(classes: DataFrame, near: dict[int, list[int]], block: int) -> DataFrame:
    """Rows of ``ROW`` with the pair of blocks ``i <= j`` they are compared in and their ``side``.

    In a crowded cell a ball that fills half a block has blocks of its own, which are compared
    with those of other balls near enough and with the loose rows, never with each other.
    """
    parts = classes.mapInArrow(_cells(False), "label string, cell bigint, ball int").groupBy("label", "cell", "ball").agg(F.count("*").alias("n"))
    own = F.when((F.col("ball") >= 0) & (F.col("n") * 2 >= block), F.col("ball")).otherwise(-1)
    parts = parts.groupBy("label", "cell", own.alias("ball")).agg(F.sum("n").alias("n"))
    group = F.struct("ball", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    layout = parts.groupBy("label", "cell").agg(F.sum("n").alias("count"), F.sort_array(F.collect_list(group)).alias("groups"))
    layout = cut(layout.filter(F.col("count") > block).drop("count"))
    groups = layout.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0))).head()[0]
    cells = classes.mapInArrow(_cells(True), ROW)
    met = cells.join(F.broadcast(layout) if groups <= BROADCAST_ROWS else layout, ["label", "cell"], "left")
    close = classes.sparkSession.createDataFrame(list(near.items()), "ball int, near array<int>")
    met = met.join(F.broadcast(close), "ball", "left")
    # a group's blocks come after those of the groups before it
    met = met.withColumn("groups", F.coalesce("groups", F.expr("array(named_struct('ball', -1, 'blocks', 1))")))
    before = F.expr("transform(groups, (g, at) -> aggregate(slice(groups, 1, at), 0, (n, x) -> n + x.blocks))")
    met = met.withColumn("groups", F.arrays_zip(F.col("groups.ball").alias("ball"), F.col("groups.blocks").alias("blocks"), before.alias("first")))
    met = met.withColumn("mine", F.expr("coalesce(get(filter(groups, g -> g.ball >= 0 AND g.ball = ball), 0), get(filter(groups, g -> g.ball < 0), 0))"))
    met = met.withColumn("own", (F.col("mine.first") + F.pmod(F.xxhash64("id"), F.col("mine.blocks"))).cast("int"))
    others = "filter(groups, g -> mine.ball < 0 OR g.ball < 0 OR (g.ball <> mine.ball AND array_contains(near, g.ball)))"
    met = met.withColumn("other", F.explode(F.expr(f"flatten(transform({others}, g -> sequence(g.first, g.first + g.blocks - 1)))")))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    names = [c.split()[0] for c in ROW.split(", ")]
    return met.select(*names, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))


def near_vectors(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vec_id, embedding, label`` -> ``vec_id, n_links, component_id, kept``, one row per row.

    Vectors are linked if their labels are equal and their cosine is at least 0.98. A vector
    that is null or zero, holds a null or non-finite component, or has no label or no id, links
    with nothing and is its own component (``kept`` is false only without an id). Vectors of
    different length are not compared. Rows that repeat an id count as rows. A link is found if the
    vectors meet in a cell: no false links, and recall is measured against brute force in the
    tests. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    nonzero = F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(usable(F.col("embedding")) & nonzero & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # a length in the label keeps vectors of different length apart
    rows = rows.withColumn("label", F.concat(F.size("embedding").cast("string"), F.lit(":"), F.col("label")))
    good = rows.filter(ok)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = stored(classes.select("id", "label", "copies", "embedding"), "vector-classes")
    classes, near = in_balls(classes, block)
    placed = _placed(classes, near, block)
    grouped = placed.repartition("label", "cell", "i", "j").sortWithinPartitions("label", "cell", "i", "j")
    found = stored(grouped.mapInArrow(_links, "a bigint, b bigint, n bigint"), "vector-links")
    more = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    links = found.filter("b IS NOT NULL").select("a", "b")
    inside = classes.filter("ball >= 0")
    # one row a ball: at most BALLS rows
    balls = cut(inside.groupBy("ball").agg(F.sum("copies").alias("all_copies"), F.min("id").alias("first")))
    links = links.unionByName(inside.join(F.broadcast(balls), "ball").select(F.col("first").alias("a"), F.col("id").alias("b")))
    roots = components(links).withColumnRenamed("node", "id")
    known = classes.join(more, "id", "left").join(roots, "id", "left").join(F.broadcast(balls), "ball", "left")
    known = stored(
        known.select(
            F.col("label").alias("class_label"), F.col("embedding").alias("class_vector"),
            (F.coalesce("all_copies", "copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("root", "id").alias("root"),
        ),
        "vector-components",
    )
    linked = good.join(known, (good["label"] == known["class_label"]) & (good["embedding"] == known["class_vector"]))
    linked = linked.select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.filter(~ok).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

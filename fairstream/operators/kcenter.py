"""Fair k-center by farthest-first traversal, exact and in the two-round coreset form.

The traversal starts at one point and repeatedly adds the point farthest from the centers so
far. A group whose budget is used up is left out while the other still has unchosen points;
once it has none, any unchosen point is taken and its own group's budget goes below zero. The
first center is charged without looking at the budget. The result has
``min(n, max(1, ka + kb))`` centers. Equal distances go to the smallest ``id``, in the second
round too (where a collected coreset would be searched by position instead).

``first`` is ``"min_id"`` or an integer seed for a uniformly drawn, reproducible first center.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fairstream.functions.distance import MAX_TERMS, nearest_in_state, nearest_to_known
from fairstream.functions.hashing import draw
from fairstream.functions.nearest import SLACK, nearest_by_part, nearest_place
from fairstream.functions.traversal import farthest_first, first_of_best
from fairstream.operators.points import is_a, with_part
from fairstream.plans.storage import cut, small_table, stored

CENTERS = "rank int, id bigint, coords array<double>, label string"
CORESET = f"part int, {CENTERS}"
GROUP_BYTES = 256 << 20
SMALL_ROWS = 10_000
#: Blocks of the lazy traversal, and the share of them that is read first.
BLOCKS, FIRST_LOOK = 256, 32
BROADCAST_BYTES = 64 << 20


def _point() -> Column:
    return F.struct("id", "coords", "label")


def _start_key(first: str | int) -> Column:
    return F.lit(0).cast("bigint") if first == "min_id" else draw(first, "id")


def _first_point(first: str | int) -> Column:
    return F.min_by(_point(), F.struct(_start_key(first).alias("key"), F.col("id").alias("id")))


def _farthest(eligible: Column, md: Column) -> Column:
    # an ineligible point wins only where no eligible one is left; ~id grows as id falls
    order = F.struct(eligible.alias("eligible"), md.alias("md"), F.bitwise_not("id").alias("tie"))
    return F.max_by(_point(), order)


def fair_fft(points: DataFrame, ka: int, kb: int, first: str | int = "min_id") -> DataFrame:
    """Exact traversal over all points: one scan and one global ``max_by`` per center.

    Nothing is shuffled but one row per task, and nothing is written: every pass computes the
    distances again from the centers so far, as literals in generated code or, past
    ``MAX_TERMS`` products per point, on Arrow batches. Keep ``points`` in Parquet or
    persisted, since it is scanned ``ka + kb`` times.
    """
    spark = points.sparkSession
    base = points.select("id", "coords", "label")
    top = base.agg(_first_point(first).alias("pick"), *_shape()).head()
    if not top.n:
        return spark.createDataFrame([], CENTERS)
    _checked(top)

    left, total = {True: ka, False: kb}, min(ka + kb, top.n)
    chosen, pick = [], top.pick
    while True:
        chosen.append(pick)
        left[pick.label == "A"] -= 1
        if len(chosen) >= total:
            break
        unchosen = base.filter(~F.col("id").isin([p.id for p in chosen]))
        md = nearest_to_known([p.coords for p in chosen], total * top.high)
        if left[True] > 0 and left[False] > 0:
            eligible = F.lit(True)
        else:
            eligible = is_a() if left[True] > 0 else ~is_a()
        pick = unchosen.agg(_farthest(eligible, md).alias("pick")).head().pick
    rows = [(rank, p.id, p.coords, p.label) for rank, p in enumerate(chosen)]
    return spark.createDataFrame(rows, CENTERS)


def fair_fft_lazy(points: DataFrame, ka: int, kb: int, first: str | int = "min_id", blocks: int = BLOCKS) -> DataFrame:
    """The centers of ``fair_fft``, with ``blocks_read``: how many blocks each took to find.

    Points are put once into blocks around ``blocks`` of them and stored in that order. Of each block
    and group the driver keeps an upper bound of the distance to the centers: the block's middle and
    radius give one, and so does what a block had when it was last read, since distances only
    fall. For a center the blocks of the largest bounds are read first, and then only those whose
    bound is not below the best found. Where points are clumped most blocks are read a few times.
    """
    spark = points.sparkSession
    base = points.select("id", "coords", "label", is_a().alias("in_a"))
    top = base.agg(_first_point(first).alias("pick"), *_shape()).head()
    if not top.n:
        return spark.createDataFrame([], f"{CENTERS}, blocks_read int")
    _checked(top)
    chosen_first = base.orderBy(F.xxhash64("id"), "id").limit(blocks).select("coords").collect()
    middles = np.array([r.coords for r in chosen_first], dtype=float).reshape(len(chosen_first), -1)
    placed = base.withColumn("near", nearest_place(F.col("coords"), middles))
    placed = placed.select("*", F.col("near.place").alias("block"), F.col("near.squared").alias("squared")).drop("near")
    dealt_out = placed.repartitionByRange("block", F.xxhash64("id")).sortWithinPartitions("block")
    held = stored(dealt_out, "lazy-blocks")
    spread = held.groupBy("block", "in_a").agg(F.sqrt(F.max("squared")).alias("radius")).collect()
    bound = {(r.block, r.in_a): math.inf for r in spread}
    radius = {(r.block, r.in_a): r.radius for r in spread}

    left, total = {True: ka, False: kb}, min(ka + kb, top.n)
    chosen, pick, read = [], top.pick, 0
    reads = []

    def lowered(center: list[float]) -> None:
        apart = np.sqrt(((middles - np.array(center)) ** 2).sum(1))
        for key in bound:
            bound[key] = min(bound[key], (apart[key[0]] + radius[key]) ** 2 * (1 + SLACK))

    def looked_at(keys: list[tuple[int, bool]]) -> list[Row]:
        """The farthest unchosen point of each block and group; their bounds become exact."""
        md = nearest_to_known([p.coords for p in chosen], total * top.high)
        own = held.filter(F.col("block").isin(sorted({k[0] for k in keys})) & ~F.col("id").isin([p.id for p in chosen]))
        asked = {g: [b for b, own_group in keys if own_group == g] for g in (True, False)}
        own = own.filter(F.when(F.col("in_a"), F.col("block").isin(asked[True])).otherwise(F.col("block").isin(asked[False])))
        found = own.withColumn("md", md).groupBy("block", "in_a").agg(_farthest(F.lit(True), F.col("md")).alias("pick"), F.max("md").alias("md")).collect()
        for key in keys:
            bound[key] = -1.0  # all chosen
        for r in found:
            bound[r.block, r.in_a] = r.md
        return found

    while True:
        chosen.append(pick)
        reads.append(read)
        left[pick.label == "A"] -= 1
        if len(chosen) >= total:
            break
        lowered(pick.coords)
        groups = {g for g in left if left[g] > 0 or left[not g] <= 0}
        keys = [k for k in bound if k[1] in groups and bound[k] >= 0]
        keys = sorted(keys or [k for k in bound if bound[k] >= 0], key=lambda k: -bound[k])
        best, read = [], 0
        while keys:
            floor = max((r.md for r in best), default=None)
            now = keys[: max(1, blocks // FIRST_LOOK)] if floor is None else [k for k in keys if bound[k] >= floor]
            keys = [] if floor is not None else keys[len(now) :]
            if now:
                read += len({k[0] for k in now})
                best += looked_at(now)
            if not keys and not best:  # the groups with a budget have no point left
                keys = sorted((k for k in bound if bound[k] >= 0), key=lambda k: -bound[k])
        pick = max(best, key=lambda r: (r.md, -r.pick.id)).pick
    rows = [(rank, p.id, p.coords, p.label, n) for rank, (p, n) in enumerate(zip(chosen, reads))]
    return spark.createDataFrame(rows, f"{CENTERS}, blocks_read int")


def mr_fair_fft(
    points: DataFrame,
    ka: int,
    kb: int,
    parts: int,
    first: str | int = "min_id",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Two rounds: the traversal in each of ``parts`` parts, then on the union of the results.

    Points that ``dealt`` has placed (and a cache holds) are solved where they are, without a shuffle.
    """
    if "part" in points.columns:
        return _on_placed(points, ka, kb, parts, first, group_bytes)
    shape = points.agg(*_shape()).head()
    dims = _checked(shape)
    coreset = local_centers(with_part(points, parts), ka, kb, parts, first, group_bytes, (shape.n, dims))
    if parts * max(1, ka + kb) * _row_bytes(dims) <= group_bytes:
        # the coreset's size is bounded by the parameters, so one group holds it
        return _merged(coreset, ka, kb, first)
    return fair_fft(stored(coreset, "coreset"), ka, kb, first)


def _merged(coreset: DataFrame, ka: int, kb: int, first: str | int) -> DataFrame:
    """Round two over a coreset that one group holds; so few rows are a literal of later plans."""
    merged = _solve_groups(coreset.withColumn("part", F.lit(0)), ka, kb, first, 1)
    return small_table(merged.drop("part"), SMALL_ROWS)[0]


def dealt(points: DataFrame, parts: int) -> DataFrame:
    """``points`` with ``part``, each part in a partition of its own: persist it and use it again and again."""
    return with_part(points, parts).repartitionById(parts, F.col("part"))


def _on_placed(points: DataFrame, ka: int, kb: int, parts: int, first: str | int, group_bytes: int) -> DataFrame:
    """The rounds over points as ``dealt`` left them; the solving tasks check the points themselves."""
    where = points.select("part", F.spark_partition_id().alias("at"), F.size("coords").alias("dims"))
    spread = [F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("dims").alias("dims")]
    found = where.groupBy("part").agg(*spread).collect()
    dims, largest = max((r.dims for r in found), default=0), max((r.n for r in found), default=0)
    if any(r.low != r.high for r in found) or max(largest, parts * max(1, ka + kb)) * _row_bytes(dims) > group_bytes:
        return mr_fair_fft(points.drop("part"), ka, kb, parts, first, group_bytes)
    return _merged(_solve_groups(points, ka, kb, first, parts, placed=True), ka, kb, first)


def local_centers(
    points: DataFrame,
    ka: int,
    kb: int,
    parts: int,
    first: str | int = "min_id",
    group_bytes: int = GROUP_BYTES,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Round one over a ``part`` column of 0..parts-1: ``part, rank, id, coords, label``.

    Parts are counted first. If the largest fits ``group_bytes``, each becomes one partition
    and is solved there, after a single shuffle. If one does not, all parts advance in step over the
    unshuffled points, so no task ever holds a part. Both give the same centers, and points of
    unequal length or with coordinates that are not finite are an error on both. ``shape`` is
    the number of points and of coordinates, if these were checked before.
    """
    if shape is None:
        found = points.agg(*_shape()).head()
        shape = found.n, _checked(found)
    count, dims = shape
    fits = group_bytes // _row_bytes(dims)
    if count <= fits or _largest_part(points) <= fits:
        return _solve_groups(points, ka, kb, first, parts)
    return _solve_in_step(points, ka, kb, first, dims)


def _largest_part(points: DataFrame) -> int:
    return points.groupBy("part").count().agg(F.max("count")).head()[0] or 0


def _shape() -> list[Column]:
    """What ``_checked`` looks at, for one pass over the points."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("coords")).alias("low"),
        F.max(F.size("coords")).alias("high"),
        # NaN counts as largest, so the extremes show every coordinate that is not finite
        F.min(F.array_min("coords")).alias("least"),
        F.max(F.array_max("coords")).alias("most"),
    ]


def _checked(shape: Row) -> int:
    """The number of coordinates; the same rule on every path, whatever the size of the input."""
    if shape.low != shape.high:
        raise ValueError(f"points have between {shape.low} and {shape.high} coordinates")
    if shape.most is not None and not (math.isfinite(shape.least) and math.isfinite(shape.most)):
        raise ValueError("points have coordinates that are not finite")
    return shape.high or 0


def _row_bytes(dims: int) -> int:
    # coordinates as sent, put together and as columns; running distance, scratch, ids and label
    return 24 * dims + 128


def _solve_groups(
    points: DataFrame, ka: int, kb: int, first: str | int, parts: int, placed: bool = False
) -> DataFrame:
    """One partition per part, each solved in memory; ``part`` is 0..parts-1.

    With ``placed`` no part lies in two partitions, and one partition may hold several.
    """
    sent = points.select(
        "part", "id", "coords", "label", is_a().alias("in_a"), _start_key(first).alias("key")
    )
    result = to_arrow_schema(StructType.fromDDL(CORESET))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        for part in whole["part"].unique().to_pylist():
            mine = whole["part"].to_numpy() == part
            yield from solved(whole if mine.all() else whole.filter(pa.array(mine)))

    def solved(group: pa.Table) -> list[pa.RecordBatch]:
        ids, keys = group["id"].to_numpy(), group["key"].to_numpy()
        coords = group["coords"].combine_chunks()
        sizes = coords.value_lengths().to_numpy(zero_copy_only=False)
        if len(sizes) and (sizes != sizes[0]).any():
            raise ValueError(f"points have between {sizes.min()} and {sizes.max()} coordinates")
        axes = coords.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).T.copy()
        if not np.isfinite(axes).all():
            raise ValueError("points have coordinates that are not finite")
        start = first_of_best(ids, -keys)
        picks = farthest_first(ids, axes, group["in_a"].to_numpy(), ka, kb, start)
        out = group.take(pa.array(picks))
        ranks = pa.array(np.arange(len(picks), dtype=np.int32))
        columns = [out["part"], ranks, out["id"], out["coords"], out["label"]]
        # the cast drops the NOT NULL that Spark may know of the coordinates
        return pa.table([c.cast(f.type) for c, f in zip(columns, result)], schema=result).to_batches()

    return (sent if placed else sent.repartitionById(parts, F.col("part"))).mapInArrow(solve, CORESET)


def _solve_in_step(
    points: DataFrame, ka: int, kb: int, first: str | int, dims: int
) -> DataFrame:
    """All parts at once, one pass per center, for parts too large for a task.

    The state is one row per part in the shared folder. It is broadcast while its size, known
    from the parameters, allows; beyond that the join is left to the optimizer. Many centers
    of a state that small go with the closure and are measured in Arrow batches.
    """
    points = points.select("part", "id", "coords", "label")
    total = max(1, ka + kb)
    state = cut(
        points.groupBy("part")
        .agg(_first_point(first).alias("pick"))
        .select("part", F.array("pick").alias("picks"), *_budgets(F.lit(ka), F.lit(kb), F.col("pick")))
    )
    small = state.count() * total * (8 * dims + 48) <= BROADCAST_BYTES
    for count in range(1, total):
        known = state.select(
            "part",
            F.expr("left_a > 0 and left_b > 0").alias("any_group"),
            F.expr("left_a > 0").alias("want_a"),
            F.col("picks.id").alias("ids"),
            F.col("picks.coords").alias("centers"),
        )
        if small and count * dims > MAX_TERMS:
            rows = state.select("part", F.col("picks.coords").alias("centers")).collect()
            md = nearest_by_part(F.col("part"), F.col("coords"), {r.part: np.array(r.centers) for r in rows})
            known = known.drop("centers")
        else:
            md = nearest_in_state("centers", count, dims)
        if small:
            known = F.broadcast(known)
        eligible = F.col("any_group") | (is_a() == F.col("want_a"))
        found = (
            points.join(known, "part")
            .filter(~F.array_contains("ids", F.col("id")))
            .select(
                *points.columns,
                eligible.alias("eligible"),
                md.alias("md"),
            )
            .groupBy("part")
            .agg(_farthest(F.col("eligible"), F.col("md")).alias("pick"))
        )
        grown = state.join(found, "part", "left")
        has = F.col("pick").isNotNull()
        state = cut(
            grown.select(
                "part",
                F.when(has, F.array_append("picks", F.col("pick"))).otherwise(F.col("picks")).alias("picks"),
                *_budgets(F.col("left_a"), F.col("left_b"), F.col("pick")),
            )
        )
        if state.filter(F.size("picks") > count).isEmpty():
            break
    return state.select("part", F.posexplode("picks").alias("rank", "p")).select(
        "part", "rank", "p.id", "p.coords", "p.label"
    )


def _budgets(left_a: Column, left_b: Column, pick: Column) -> list[Column]:
    took_a = pick.isNotNull() & is_a(pick["label"])
    took_b = pick.isNotNull() & ~is_a(pick["label"])
    return [
        (left_a - took_a.cast("int")).alias("left_a"),
        (left_b - took_b.cast("int")).alias("left_b"),
    ]

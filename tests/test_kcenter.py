import math
import random

import numpy as np
import pytest

from fairstream.functions import distance
from fairstream.operators import kcenter, radius
from fairstream.operators.kcenter import dealt, fair_fft, fair_fft_lazy, local_centers, mr_fair_fft
from fairstream.operators.points import with_part

SCHEMA = "id bigint, coords array<double>, label string"


def gap(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y))


def brute(points, ka, kb, start=None):
    """Ids in order, straight from the definition, for distinct ids."""
    if not points:
        return []
    at = min(points) if start is None else start
    chosen, budget = [at], [ka, kb]
    budget[points[at][1] != "A"] -= 1
    while len(chosen) < min(ka + kb, len(points)):
        rest = [i for i in points if i not in chosen]
        if budget[0] <= 0 or budget[1] <= 0:
            group = budget[0] > 0
            rest = [i for i in rest if (points[i][1] == "A") == group] or rest
        far = {i: min(gap(points[i][0], points[c][0]) for c in chosen) for i in rest}
        at = min(rest, key=lambda i: (-far[i], i))
        chosen.append(at)
        budget[points[at][1] != "A"] -= 1
    return chosen


def cloud(count, dims, seed, span=20, labels="AAABC"):
    """Whole-number points with many ties and copies."""
    rng = random.Random(seed)
    return {
        i * 3: ([float(rng.randrange(span)) for _ in range(dims)], rng.choice(labels))
        for i in range(count)
    }


def frame(spark, points, parts=4):
    rows = [(i, x, label) for i, (x, label) in points.items()]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def ids(centers):
    return [r.id for r in centers.orderBy("rank").collect()]


CASES = [
    (cloud(60, 2, 1), 4, 3),
    (cloud(60, 2, 2), 0, 5),
    (cloud(60, 3, 3), 5, 0),
    (cloud(40, 1, 4, span=3), 3, 9),
    (cloud(30, 2, 5, labels="AAAAAAAAAB"), 2, 8),
    (cloud(9, 2, 6), 10, 10),
    (cloud(20, 2, 7), 0, 0),
    (cloud(1, 2, 8), 2, 2),
    ({i: ([1.0, 1.0], "AB"[i % 2]) for i in range(6)}, 2, 2),
]


@pytest.mark.parametrize("points,ka,kb", CASES)
def test_exact_traversal(spark, points, ka, kb):
    df = frame(spark, points)
    centers = fair_fft(df, ka, kb)
    assert ids(centers) == brute(points, ka, kb)
    assert centers.count() == min(len(points), max(1, ka + kb))
    labels = {r.id: (r.coords, r.label) for r in centers.collect()}
    assert all(points[i] == v for i, v in labels.items())


@pytest.mark.parametrize(
    "points,ka,kb,bytes_",
    [(*c, kcenter.GROUP_BYTES) for c in CASES[:7]] + [(*c, 0) for c in (CASES[0], CASES[3], CASES[4])],
)
def test_both_round_one_paths(spark, points, ka, kb, bytes_):
    found = local_centers(with_part(frame(spark, points), 4), ka, kb, 4, group_bytes=bytes_)
    by_part = {}
    for r in found.orderBy("part", "rank").collect():
        by_part.setdefault(r.part, []).append(r.id)
    split = {}
    for i, p in points.items():
        split.setdefault(i % 4, {})[i] = p
    assert by_part == {k: brute(v, ka, kb) for k, v in split.items()}


def test_two_rounds(spark):
    points = cloud(80, 2, 9)
    coreset = {}
    for part in range(5):
        own = {i: p for i, p in points.items() if i % 5 == part}
        coreset |= {i: points[i] for i in brute(own, 4, 2)}
    df = frame(spark, points)
    expected = brute(coreset, 4, 2)
    assert ids(mr_fair_fft(df, 4, 2, 5)) == expected
    # no group may hold anything: both rounds take the distributed paths
    assert ids(mr_fair_fft(df, 4, 2, 5, group_bytes=0)) == expected
    assert ids(mr_fair_fft(df, 4, 2, 5000)) == brute(points, 4, 2)


def test_one_part_is_the_exact_traversal(spark):
    df = frame(spark, cloud(50, 4, 10))
    assert ids(mr_fair_fft(df, 3, 3, 1)) == ids(fair_fft(df, 3, 3))


def test_a_part_with_most_points_is_no_problem(spark):
    points = {i * 4: p for i, p in enumerate(cloud(70, 2, 11).values())} | {1: ([0.0, 0.0], "A")}
    df = with_part(frame(spark, points), 4)
    in_step = local_centers(df, 3, 2, 4, group_bytes=0).orderBy("part", "rank").collect()
    assert in_step == local_centers(df, 3, 2, 4).orderBy("part", "rank").collect()


def test_coordinates_known_to_be_not_null(spark):
    xs = "array(coalesce(double(id % 7), 0D), coalesce(double(id % 5), 0D))"
    points = spark.range(30).selectExpr("id", f"{xs} AS coords", "'A' AS label")
    assert not points.schema["coords"].dataType.containsNull
    found = ids(mr_fair_fft(points, 3, 2, 4))
    assert found == ids(mr_fair_fft(points, 3, 2, 4, group_bytes=0)) and len(found) == 5


def test_empty_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fair_fft(none, 2, 2).count() == 0
    assert mr_fair_fft(none, 2, 2, 3).count() == 0
    assert local_centers(with_part(none, 3), 2, 2, 3, group_bytes=-1).count() == 0


def test_seed_moves_the_first_center_and_nothing_else(spark):
    points = cloud(50, 2, 12)
    df = frame(spark, points)
    starts = set()
    for seed in range(5):
        found = ids(fair_fft(df, 3, 2, first=seed))
        assert found == brute(points, 3, 2, start=found[0])
        assert found == ids(mr_fair_fft(df, 3, 2, 1, first=seed))
        assert found == ids(mr_fair_fft(df.repartition(3), 3, 2, 1, first=seed, group_bytes=0))
        starts.add(found[0])
    assert len(starts) > 1


def test_folded_distances_change_nothing(spark, monkeypatch):
    points = cloud(60, 3, 13)
    df = frame(spark, points)
    for terms in (9, 1):  # fold every few centers; lambda form
        monkeypatch.setattr(kcenter, "MAX_TERMS", terms)
        monkeypatch.setattr(distance, "MAX_TERMS", terms)
        assert ids(fair_fft(df, 6, 5)) == brute(points, 6, 5)
        in_step = local_centers(with_part(df, 1), 6, 5, 1, group_bytes=0)
        assert ids(in_step) == brute(points, 6, 5)


@pytest.mark.parametrize("rows", [
    [(0, [1.0], "A"), (1, [1.0, 2.0], "B")],
    [(0, [1.0, 2.0], "A"), (1, [5.0], "A"), (2, [7.0, 8.0, 9.0], "B"), (3, [0.0, 0.0], "B")],
    [(0, [1.0, 2.0], "A"), (1, [float("nan"), 2.0], "B")],
    [(0, [1.0, 2.0], "A"), (1, [1.0, float("-inf")], "B")],
])
@pytest.mark.parametrize("bytes_", [0, kcenter.GROUP_BYTES])
def test_ragged_and_infinite_points_are_an_error_on_every_path(spark, rows, bytes_):
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError):
        fair_fft(df, 1, 1)
    with pytest.raises(ValueError):
        mr_fair_fft(df, 1, 1, 2, group_bytes=bytes_)
    with pytest.raises(ValueError):
        local_centers(with_part(df, 2), 1, 1, 2, group_bytes=bytes_)


@pytest.mark.parametrize("count", [256, 257, 4100])
def test_centers_need_no_rank(spark, count):
    centers = spark.range(count).selectExpr("array(CAST(id * 2 AS DOUBLE)) AS coords")
    points = spark.createDataFrame([(0, [5.25], "A"), (1, [-3.0], "B")], SCHEMA)
    assert {r.id: r.distance for r in radius.nearest_center(points, centers).collect()} == {0: 0.75, 1: 3.0}


@pytest.mark.parametrize("terms,bytes_", [(256, 64 << 20), (0, 64 << 20), (0, 40)])
def test_nearest_center_and_radius(spark, monkeypatch, terms, bytes_):
    monkeypatch.setattr(radius, "MAX_TERMS", terms)
    monkeypatch.setattr(radius, "CENTER_BYTES", bytes_)
    points = cloud(40, 3, 14)
    df = frame(spark, points)
    centers = fair_fft(df, 3, 2)
    at = [points[i][0] for i in ids(centers)]
    expected = {i: math.sqrt(min(gap(x, c) for c in at)) for i, (x, _) in points.items()}
    found = {r.id: r.distance for r in radius.nearest_center(df, centers).collect()}
    assert found == pytest.approx(expected)
    assert radius.objective(df, centers).head()[0] == pytest.approx(max(expected.values()))


def test_radius_without_points_is_null_and_without_centers_an_error(spark):
    points, none = frame(spark, cloud(5, 2, 15)), spark.createDataFrame([], SCHEMA)
    assert radius.objective(none, fair_fft(points, 1, 1)).head()[0] is None
    with pytest.raises(ValueError):
        radius.objective(points, fair_fft(none, 1, 1))


def test_round_one_shuffles_once_and_sorts_nothing(spark):
    df = with_part(frame(spark, cloud(30, 2, 17)), 4)
    plan = kcenter._solve_groups(df, 3, 2, "min_id", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "Sort" not in plan


def test_passes_scan_without_shuffling_points(spark, tmp_path):
    """The per-center plan has one exchange, to a single partition, of partial results."""
    frame(spark, cloud(20, 2, 16)).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    step = df.agg(kcenter._farthest(df.id > 0, distance.nearest_to_known([[1.0, -2.0]])))
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan


def clumped(n, clumps, dims, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 100, (clumps, dims))
    return middles[rng.integers(0, clumps, n)] + rng.normal(0, 1, (n, dims))


@pytest.mark.parametrize("budgets", [(40, 20), (3, 90), (0, 60)])
@pytest.mark.parametrize("make", [lambda: clumped(3000, 30, 4), lambda: np.random.default_rng(1).integers(0, 6, (2000, 3)).astype(float)])
def test_clusters_give_the_plain_traversal(monkeypatch, make, budgets):
    from fairstream.functions import traversal

    points = make()
    ids = np.random.default_rng(2).permutation(len(points))
    in_a = ids % 13 < 10
    axes = points.T.copy()
    pruned = traversal.Clusters(ids, axes, in_a)
    got = pruned.farthest_first(*budgets, 5)
    monkeypatch.setattr(traversal, "LEAST_FOR_CLUSTERS", 10**9)
    assert got == traversal.farthest_first(ids, axes, in_a, *budgets, 5)
    if len(points) == 3000:  # clumps: most clusters are left out
        assert pruned.distances < 0.5 * len(points) * sum(budgets)


def lazy_points(spark, n=6000, clumps=40):
    rows = [(i, x.tolist(), "A" if i % 13 < 10 else "B") for i, x in enumerate(clumped(n, clumps, 3, seed=4))]
    return spark.createDataFrame(rows, "id bigint, coords array<double>, label string")


def test_lazy_traversal_reads_few_blocks_of_clumped_points(spark):
    points = lazy_points(spark).cache()
    plain = [r.id for r in fair_fft(points, 12, 6).orderBy("rank").collect()]
    lazy = fair_fft_lazy(points, 12, 6, blocks=120).orderBy("rank").collect()
    assert [r.id for r in lazy] == plain
    assert sum(r.blocks_read for r in lazy) < 120 * 18 / 3


@pytest.mark.parametrize("budgets", [(2, 2), (0, 3), (4, 0), (20, 20)])
def test_lazy_traversal_of_few_and_equal_points(spark, budgets):
    """Ties, repeated points, a group that runs out and more centers than points."""
    rows = [(i, [float(i % 3), 0.0], "A" if i < 4 else "B") for i in range(12)]
    points = spark.createDataFrame(rows, "id bigint, coords array<double>, label string")
    plain = [tuple(r) for r in fair_fft(points, *budgets).orderBy("rank").collect()]
    lazy = fair_fft_lazy(points, *budgets, blocks=5).drop("blocks_read").orderBy("rank").collect()
    assert [tuple(r) for r in lazy] == plain
    assert fair_fft_lazy(points.limit(0), *budgets).collect() == []


def test_placed_points_need_no_shuffle(spark):
    points = lazy_points(spark, 4000)
    held = dealt(points, 6).persist()
    plain = [tuple(r) for r in mr_fair_fft(points, 5, 3, 6).orderBy("rank").collect()]
    assert [tuple(r) for r in mr_fair_fft(held, 5, 3, 6).orderBy("rank").collect()] == plain
    # a part in several partitions is dealt again
    assert [tuple(r) for r in mr_fair_fft(held.repartition(4), 5, 3, 6).orderBy("rank").collect()] == plain
    held.unpersist()
    bad = spark.createDataFrame([(1, [1.0, 2.0], "A"), (2, [float("nan"), 0.0], "A")], points.schema)
    with pytest.raises(Exception, match="not finite"):
        mr_fair_fft(dealt(bad, 2), 1, 1, 2)

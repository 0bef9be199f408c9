"""Distances in Arrow batches against the SQL form, and their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairstream.functions import distance
from fairstream.functions.nearest import nearest_by_part, nearest_in_batches
from fairstream.plans.storage import small_table

CENTERS = np.random.default_rng(3).normal(size=(40, 3))


def test_batches_agree_with_literals_to_the_bit(spark):
    points = spark.range(300).select("id", F.array(F.randn(1), F.randn(2), F.randn(3)).alias("coords")).cache()
    literal = distance.nearest_to_known(CENTERS.tolist(), 0)
    both = points.select(literal.alias("a"), nearest_in_batches(F.col("coords"), CENTERS).alias("b"))
    assert both.filter("NOT a <=> b").isEmpty()
    half = nearest_in_batches(F.col("coords"), CENTERS[:17])
    chained = nearest_in_batches(F.col("coords"), CENTERS[17:], half)
    assert points.filter(~chained.eqNullSafe(literal)).isEmpty()


def test_points_of_another_length_or_with_nulls_have_no_distance(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, []), (5, [float("nan"), 0.0]), (6, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id bigint, coords array<double>").coalesce(1)
    found = df.select("id", nearest_in_batches(F.col("coords"), np.zeros((2, 2))).alias("md")).collect()
    by_id = {r.id: r.md for r in found}
    assert np.isnan(by_id.pop(5))
    assert by_id == {0: 0.0, 1: None, 2: None, 3: None, 4: None, 6: 25.0}


def test_each_part_has_its_own_centers(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (0, [9.0])], "part int, coords array<double>")
    centers = {0: np.array([[0.0], [10.0]]), 1: np.array([[5.0]])}
    md = nearest_by_part(F.col("part"), F.col("coords"), centers)
    assert sorted(r.md for r in df.select(md.alias("md")).collect()) == [1.0, 1.0, 16.0]


@pytest.mark.parametrize("rows", [0, 5, 6])
def test_small_tables_keep_all_rows(spark, rows):
    kept, count = small_table(spark.range(rows), 5)
    assert count == rows and sorted(r.id for r in kept.collect()) == list(range(rows))


@pytest.mark.parametrize("clumps", [1, 40])
def test_balls_of_centers_agree_to_the_bit(clumps):
    from fairstream.functions import nearest

    rng = np.random.default_rng(clumps)
    middles = rng.normal(0, 50, (clumps, 5))
    centers = middles[rng.integers(0, clumps, 2000)] + rng.normal(0, 1, (2000, 5))
    points = middles[rng.integers(0, clumps, 3000)] + rng.normal(0, 1, (3000, 5))
    points[:3] = [[np.inf] * 5, [np.nan] * 5, [1e300] * 5]
    points[3:9] = centers[:6]
    with np.errstate(all="ignore"):
        tree = nearest.CenterTree(centers)
        got, plain = tree.squared(points.T.copy()), nearest.squared_to_nearest(points.T.copy(), centers)
    assert np.array_equal(got, plain, equal_nan=True)
    assert clumps == 1 or tree.products < 0.2 * len(centers) * len(points)


def test_ten_thousand_centers_in_one_pass(spark):
    from fairstream.operators.radius import nearest_center

    rng = np.random.default_rng(3)
    at = rng.normal(0, 100, (60, 3))
    rows = [(i, (at[i % 60] + rng.normal(0, 1, 3)).tolist()) for i in range(12_000)]
    centers = spark.createDataFrame(rows[:10_000], "id bigint, coords array<double>").select("coords")
    points = spark.createDataFrame(rows[10_000:], "id bigint, coords array<double>")
    found = {r.id: r.distance for r in nearest_center(points, centers).collect()}
    known = np.array([c for _, c in rows[:10_000]])
    assert all(found[i] == pytest.approx(np.sqrt(((known - np.array(c)) ** 2).sum(1).min()), rel=1e-12) for i, c in rows[10_000:10_200])

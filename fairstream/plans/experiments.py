"""Whole runs built from the operators: clustering with its radius, and quality experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairstream.operators import frequency as fq
from fairstream.operators.kcenter import mr_fair_fft
from fairstream.operators.points import label_counts
from fairstream.operators.radius import objective


def clustering_report(points: DataFrame, ka: int, kb: int, parts: int) -> DataFrame:
    """One row: ``n, na, nb`` and the radius of the two-round centers."""
    centers = mr_fair_fft(points, ka, kb, parts)
    radius = objective(points, centers)
    return label_counts(points).select("n", "na", "nb", radius.scalar().alias("objective"))


def quality_runs(
    items: DataFrame,
    n: int,
    phi: float,
    epsilons: Sequence[float],
    widths: Sequence[int],
    class_epsilon: float,
    seeds: Sequence[int],
) -> DataFrame:
    """``algorithm, param, run, frequent, almost, rare, size``: one row per parameter and seed.

    Sticky answers are graded with their own epsilon, count-min answers with
    ``class_epsilon``. ``size`` is the sample size or the returned total. All runs of an
    algorithm share their scans of the items.
    """
    sticky = [fq.Frequency(n, phi, e, seed=s) for e in epsilons for s in seeds]
    sketches = [fq.Frequency(n, phi, class_epsilon, width=w, seed=s) for w in widths for s in seeds]

    firsts = fq.first_sampled(items, sticky)
    threshold = F.array(*[F.lit(run.sticky_threshold) for run in sticky])[F.col("run")]
    found = fq.sticky_samples(items, sticky, firsts).filter(F.col("n") >= threshold)
    graded = fq.quality_counts(found, sticky)
    sizes = firsts.groupBy("run").agg(F.count(F.lit(1)).alias("size"))
    sticky_rows = _labelled(
        items, "sticky", [e for e in epsilons for _ in seeds], len(seeds), graded.join(sizes, "run", "right")
    )

    found = fq.countmin_frequents(items, sketches).withColumnRenamed("n", "true_freq")
    graded = fq.quality_counts(found, sketches).withColumn("size", F.col("total"))
    sketch_rows = _labelled(items, "countmin", [w for w in widths for _ in seeds], len(seeds), graded)
    return sticky_rows.unionByName(sketch_rows)


def _labelled(
    items: DataFrame, algorithm: str, params: Sequence[float], repeats: int, counts: DataFrame
) -> DataFrame:
    """Every run with its parameter; counts of a run that reported nothing are 0."""
    plan = [(i, algorithm, float(p), i % repeats) for i, p in enumerate(params)]
    named = items.sparkSession.createDataFrame(plan, "id int, algorithm string, param double, run int")
    counts = counts.withColumnRenamed("run", "id")
    return named.join(counts, "id", "left").select(
        "algorithm",
        "param",
        "run",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("frequent", "almost", "rare", "size")],
    )

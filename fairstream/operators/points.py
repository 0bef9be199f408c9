"""Counts and partitioning of labelled points ``<id bigint, coords array<double>, label string>``.

Group ``A`` is the label ``A``; every other label belongs to the second group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_a(label: Column | str = "label") -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return label.eqNullSafe(F.lit("A"))


def label_counts(points: DataFrame) -> DataFrame:
    """One row ``n, na, nb`` from one pass."""
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_a()).alias("na"),
        F.count_if(~is_a()).alias("nb"),
    )


def with_part(points: DataFrame, parts: int) -> DataFrame:
    """Reproducible stand-in for a round-robin split: ``part = id mod parts``."""
    return points.withColumn("part", F.pmod("id", F.lit(parts).cast("bigint")).cast("int"))

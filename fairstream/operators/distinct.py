"""Distinct items and maximum of a stream cut into batches ``<batch bigint, item bigint>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairstream.operators.selection import kth_smallest


def whole_batches(items: DataFrame, threshold: int) -> DataFrame:
    """Batches are taken whole while fewer than ``threshold`` items have been seen.

    The last batch taken is the one that holds item number ``threshold`` in batch order.
    """
    if threshold <= 0:
        return items.limit(0)
    last = kth_smallest(items, "batch", threshold)
    return items if last is None else items.filter(F.col("batch") <= last)


def batch_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))


def distinct_by_batch(items: DataFrame) -> DataFrame:
    return items.select("batch", "item").distinct()


def distinct_items(items: DataFrame) -> DataFrame:
    return items.select("item").distinct()


def distinct_report(items: DataFrame) -> DataFrame:
    """One row ``items, distinct_items, largest``; ``largest`` is NULL without items."""
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        F.countDistinct("item").alias("distinct_items"),
        F.max("item").alias("largest"),
    )

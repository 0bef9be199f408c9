"""Order statistics without a global sort."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: Of the quantile summary: a rank is off by at most ``rows / ACCURACY``.
ACCURACY = 10_000
#: So many values, 8 MB, are selected from on the driver.
MOST_VALUES = 1_000_000


def kth_smallest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest value (k from 1) of a bigint column, or None if there are fewer rows.

    Three passes. A quantile summary, merged from those of the tasks, gives two values around the
    answer; the second pass counts the rows below and between them; the third fetches what lies
    between, some ``4 / ACCURACY`` of the rows. If that is more than ``MOST_VALUES`` (or the summary
    missed), slices of the range are counted instead.
    """
    rows = df.agg(F.count(column)).head()[0]  # of a table in files: its metadata
    if k > rows or k < 1:
        return None
    near = [min(1.0, max(0.0, k / rows + side * 2 / ACCURACY)) for side in (-1, 1)]
    low, high = df.agg(F.percentile_approx(column, near, ACCURACY)).head()[0]
    between = F.col(column).between(low, high)
    below, inside = df.agg(F.count_if(F.col(column) < low), F.count_if(between)).head()
    if not below < k <= below + inside:
        return _by_slices(df, column, k)
    if low == high:
        return low
    if inside > MOST_VALUES:
        return _by_slices(df.filter(between), column, k - below)
    values = df.filter(between).select(column).toArrow()[column].to_numpy()
    return int(np.partition(values, k - below - 1)[k - below - 1])


def _by_slices(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest value (k from 1) of a bigint column, or None if there are fewer rows.

    Each pass counts the rows in about ``BUCKETS`` slices of the remaining range and goes on
    with the slice that holds the answer: seven passes for the full bigint range.
    """
    top = df.agg(F.min(column), F.max(column), F.count(column)).head()
    low, high, rows = top
    if k > rows:
        return None
    while low < high:
        width = (high - low) // BUCKETS + 1
        slice_of = F.expr(f"{column} div {width}L")  # rounds towards zero, so no overflow
        sizes = (
            df.filter(F.col(column).between(low, high))
            .groupBy(slice_of.alias("slice"))
            .count()
            .orderBy("slice")
            .collect()
        )
        for slice_no, size in sizes:
            if k <= size:
                break
            k -= size
        first = slice_no * width
        low = max(low, first - (width - 1 if slice_no <= 0 else 0))
        high = min(high, first + (width - 1 if slice_no >= 0 else 0))
    return low

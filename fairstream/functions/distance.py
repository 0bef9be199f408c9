"""Squared Euclidean distances as Catalyst expressions.

For few terms the sum is written out per center and coordinate, which stays inside
whole-stage codegen (about five times faster than the lambda form at ten centers in seven
dimensions). Above ``MAX_TERMS`` the generated method would outgrow what the JIT compiles, and
known centers are measured in Arrow batches; the lambda form is for distances between columns.
All add the coordinates in the same order and agree to the bit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fairstream.functions.nearest import nearest_in_batches

MAX_TERMS = 256


def double_sql(x: float) -> str:
    if math.isfinite(x):
        return f"({float(x)!r}D)"
    return f"double('{x}')"


def _written_out(axes: Sequence[tuple[str, str]]) -> str:
    return " + ".join(f"({x} - {c}) * ({x} - {c})" for x, c in axes) or "0D"


def _smallest(terms: Sequence[str]) -> Column:
    return F.expr(f"least({', '.join(terms)})" if len(terms) > 1 else terms[0])


def lambda_distance(x: Column, c: Column) -> Column:
    gaps = F.zip_with(x, c, lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)


def squared_distance(x: Column | str, c: Column | str) -> Column:
    """Distance of two coordinate columns of any, also unknown, dimension."""
    as_col = lambda v: F.col(v) if isinstance(v, str) else v
    return lambda_distance(as_col(x), as_col(c))


def nearest_to_known(centers: Sequence[Sequence[float]], terms: int | None = None) -> Column:
    """Squared distance from ``coords`` to the closest of some known centers.

    ``terms``, by default the number of products, decides between literals and Arrow batches; a
    caller that will ask for more and more centers passes what it will come to.
    """
    if (sum(map(len, centers)) if terms is None else terms) > MAX_TERMS:
        return nearest_in_batches(F.col("coords"), np.array(centers, dtype=float))
    return _smallest([_written_out([(f"coords[{i}]", double_sql(v)) for i, v in enumerate(c)]) for c in centers])


def nearest_in_array(centers: Column) -> Column:
    """The same against an ``array<array<double>>`` column of any length."""
    return F.aggregate(
        centers, F.lit(float("inf")), lambda best, c: F.least(best, lambda_distance(F.col("coords"), c))
    )


def nearest_in_state(centers: str, count: int, dims: int) -> Column:
    """The same against a column that holds up to ``count`` centers, differing by row."""
    if count * dims > MAX_TERMS:
        return nearest_in_array(F.col(centers))
    terms = [
        _written_out([(f"coords[{i}]", f"get(get({centers}, {j}), {i})") for i in range(dims)])
        for j in range(count)
    ]
    return _smallest(terms)

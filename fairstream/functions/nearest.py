"""Squared distance to the closest of many known centers, on Arrow batches.

The centers travel in the closure, so a pass over the points needs no join and stores nothing.
Coordinates are added in the order of the SQL expression, and the results agree to the bit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

# tasks get these functions with the closure, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CENTERS_AT_ONCE = 16
#: From so many centers on they are put into groups, and whole groups are left out by bounds.
LEAST_FOR_TREE = 64
#: Far above the rounding of a distance, far below what would cost.
SLACK = 1e-9


def squared_to_nearest(axes: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """``axes`` holds one row per coordinate, ``centers`` one row per center. NaN counts as largest."""
    best = np.full(axes.shape[1], np.nan)
    for low in range(0, len(centers), CENTERS_AT_ONCE):
        block = centers[low : low + CENTERS_AT_ONCE]
        total = np.zeros((len(block), axes.shape[1]))
        for axis, at in zip(axes, block.T):
            gap = axis - at[:, None]
            gap *= gap
            total += gap
        np.fmin(best, np.fmin.reduce(total), out=best)
    return best


class CenterTree:
    """Centers in some ``sqrt(n)`` balls, each around one of them.

    By the triangle inequality no center of a ball is closer to a point than the distance to the
    ball's own center less the radius. Distances are computed as in ``squared_to_nearest``, and what is
    left out is farther by more than any rounding, so the results agree to the bit.
    """

    def __init__(self, centers: np.ndarray):
        self.centers = centers
        balls = int(np.ceil(np.sqrt(len(centers))))
        nearest = np.full(len(centers), np.inf)
        own, middles, at = np.zeros(len(centers), np.int64), [], 0
        for ball in range(balls):  # farthest-first, as the clustering itself
            middles.append(at)
            gap = ((centers - centers[at]) ** 2).sum(1)
            closer = gap < nearest
            nearest[closer], own[closer] = gap[closer], ball
            at = int(nearest.argmax())
        self.middles = centers[middles]
        self.balls = [np.flatnonzero(own == ball) for ball in range(balls)]
        self.radii = np.array([np.sqrt(nearest[b].max(initial=0.0)) for b in self.balls])
        self.products = 0

    def squared(self, axes: np.ndarray) -> np.ndarray:
        n = axes.shape[1]
        to_middle = np.stack([squared_to_nearest(axes, m[None]) for m in self.middles])
        self.products += to_middle.size
        home = np.where(np.isnan(to_middle), np.inf, to_middle).argmin(0)
        best = np.fmin.reduce(to_middle)

        def meet(ball: int, points: np.ndarray) -> None:
            members = self.centers[self.balls[ball]]
            if len(points) and len(members):
                self.products += len(points) * len(members)
                best[points] = np.fmin(best[points], squared_to_nearest(axes[:, points], members))

        for ball in range(len(self.balls)):
            meet(ball, np.flatnonzero(home == ball))
        far = np.sqrt(to_middle)
        least = far - self.radii[:, None] - SLACK * (far + self.radii[:, None])
        reach = np.sqrt(best)
        for ball in range(len(self.balls)):
            meet(ball, np.flatnonzero((least[ball] <= reach) & (home != ball)))
            if n:
                reach = np.sqrt(best)
        return best


def nearest_place(coords: Column, centers: np.ndarray) -> Column:
    """``struct<place int, squared double>``: the first of the closest centers and the squared distance to it."""

    def measured(points: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in points:
            axes, whole = columns_of(batch, centers.shape[1])
            best, place = np.full(axes.shape[1], np.inf), np.zeros(axes.shape[1], np.int32)
            for i, center in enumerate(centers):
                gap = squared_to_nearest(axes, center[None])
                closer = gap < best
                best[closer], place[closer] = gap[closer], i
            out, at = np.full(len(batch), np.nan), np.zeros(len(batch), np.int32)
            out[whole], at[whole] = best, place
            yield pa.StructArray.from_arrays([pa.array(at), pa.array(out)], ["place", "squared"])

    measured.__annotations__ = {"points": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(measured, "place int, squared double")(coords)


def columns_of(coords: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """One row per coordinate of the points that have ``dims`` of them and no null, and which these are."""
    whole = pc.fill_null(pc.list_value_length(coords), -1).to_numpy(zero_copy_only=False) == dims
    kept = coords if whole.all() else coords.filter(pa.array(whole))
    flat = kept.flatten()
    values = flat.to_numpy(zero_copy_only=False).reshape(len(kept), dims)
    if flat.null_count:
        full = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(kept), dims).any(axis=1)
        whole[whole], values = full, values[full]
    return values.T.copy(), whole


def nearest_in_batches(coords: Column, centers: np.ndarray, carried: Column | None = None) -> Column:
    """Squared distance from ``coords``; NULL for points of another length or with a null.

    ``carried`` is the distance to other centers.
    """

    tree = CenterTree(centers) if len(centers) >= LEAST_FOR_TREE and np.isfinite(centers).all() else None

    def measured(points: pa.Array, *before: pa.Array) -> pa.Array:
        axes, whole = columns_of(points, centers.shape[1])
        out = np.full(len(points), np.nan)
        out[whole] = tree.squared(axes) if tree else squared_to_nearest(axes, centers)
        if before:
            np.fmin(out, before[0].to_numpy(zero_copy_only=False), out=out)
        return pa.array(out, mask=~whole, from_pandas=False)

    udf = F.arrow_udf(measured, "double", ArrowUDFType.SCALAR)
    return udf(coords) if carried is None else udf(coords, carried)


def nearest_by_part(part: Column, coords: Column, centers: dict[int, np.ndarray]) -> Column:
    """The same, each point against the centers of its own part."""

    def measured(parts: pa.Array, points: pa.Array) -> pa.Array:
        out = np.full(len(points), np.nan)
        axes, whole = columns_of(points, next(iter(centers.values())).shape[1])
        inside, found = parts.to_numpy()[whole], np.empty(axes.shape[1])
        for number in np.unique(inside):
            mine = inside == number
            found[mine] = squared_to_nearest(axes[:, mine], centers[int(number)])
        out[whole] = found
        return pa.array(out, mask=~whole, from_pandas=False)

    return F.arrow_udf(measured, "double", ArrowUDFType.SCALAR)(part, coords)

"""Farthest-first traversal of one bounded group, run inside a task on NumPy columns."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# tasks get these functions with the closure, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: From so many centers on points are kept by their nearest center, and whole clusters are left out.
LEAST_FOR_CLUSTERS = 48
#: Far above the rounding of a distance.
SLACK = 1e-9


def farthest_first(
    ids: np.ndarray, axes: np.ndarray, in_a: np.ndarray, ka: int, kb: int, start: int
) -> list[int]:
    """Positions of the centers of one bounded group; ``axes`` holds one row per coordinate.

    Works in place on a few columns as long as the group, without sorting it.
    """
    if min(ka + kb, len(ids)) >= LEAST_FOR_CLUSTERS:
        return Clusters(ids, axes, in_a).farthest_first(ka, kb, start)
    budget = {True: ka, False: kb}
    nearest = np.full(len(ids), np.inf)
    unchosen = np.ones(len(ids), dtype=bool)
    gap, step = np.empty(len(ids)), np.empty(len(ids))
    picks: list[int] = []
    at = start
    while True:
        picks.append(at)
        unchosen[at] = False
        budget[bool(in_a[at])] -= 1
        if len(picks) >= min(ka + kb, len(ids)):
            return picks
        gap.fill(0.0)
        for axis in axes:  # coordinate by coordinate, the order the SQL expression uses
            np.subtract(axis, axis[at], out=step)
            np.multiply(step, step, out=step)
            gap += step
        np.minimum(nearest, gap, out=nearest)
        pool = unchosen
        if budget[False] <= 0:
            pool = unchosen & in_a
        elif budget[True] <= 0:
            pool = unchosen & ~in_a
        if not pool.any():
            pool = unchosen
        at = first_of_best(ids, np.where(pool, nearest, -1.0))


def _squared(axes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Coordinate by coordinate, the order the SQL expression uses."""
    gap = np.zeros(axes.shape[1])
    for axis, x in zip(axes, at):
        step = axis - x
        gap += step * step
    return gap


class Cluster:
    """The points nearest to one center, with their squared distances, and the best of each group."""

    def __init__(self, center: np.ndarray, place: np.ndarray, axes: np.ndarray, nearest: np.ndarray):
        self.center, self.place, self.axes, self.nearest = center, place, axes, nearest
        self.best: dict[bool, tuple[float, int, int] | None] = {}

    @property
    def radius(self) -> float:
        return float(self.nearest.max(initial=0.0))


class Clusters:
    """Farthest-first traversal that leaves out whole clusters by the triangle inequality.

    A point keeps its nearest center if that is at most half as far as the new center is from it.
    Where even the farthest point of a cluster is that close, no distance of it is computed.
    """

    def __init__(self, ids: np.ndarray, axes: np.ndarray, in_a: np.ndarray):
        self.ids, self.axes, self.in_a = ids, axes, in_a
        self.unchosen = np.ones(len(ids), dtype=bool)
        self.clusters: list[Cluster] = []
        self.distances = 0

    def add(self, at: int) -> None:
        center = self.axes[:, at].copy()
        self.unchosen[at] = False
        if not self.clusters:
            place = np.arange(len(self.ids))
            self.distances += len(place)
            self.clusters.append(Cluster(center, place, self.axes, _squared(self.axes, center)))
            return
        moved = []
        for cluster in self.clusters:
            apart = float(((cluster.center - center) ** 2).sum())
            if apart >= 4 * cluster.radius * (1 + SLACK):
                continue
            gap = _squared(cluster.axes, center)
            self.distances += len(gap)
            closer = gap < cluster.nearest
            if closer.any():
                moved.append((cluster.place[closer], cluster.axes[:, closer], gap[closer]))
                kept = ~closer
                cluster.place, cluster.axes, cluster.nearest = cluster.place[kept], cluster.axes[:, kept], cluster.nearest[kept]
                cluster.best = {}
        parts = list(zip(*moved)) or [(np.zeros(0, np.int64),), (self.axes[:, :0],), (np.zeros(0),)]
        self.clusters.append(Cluster(center, np.concatenate(parts[0]), np.concatenate(parts[1], axis=1), np.concatenate(parts[2])))

    def _best(self, cluster: Cluster, group: bool) -> tuple[float, int, int] | None:
        """Largest distance, smallest id and place of the unchosen points of a group."""
        held = cluster.best.get(group)
        if group not in cluster.best or held and not self.unchosen[held[2]]:
            mine = np.flatnonzero(self.unchosen[cluster.place] & (self.in_a[cluster.place] == group))
            if len(mine):
                most = cluster.nearest[mine].max()
                ties = cluster.place[mine[cluster.nearest[mine] == most]]
                place = int(ties[np.argmin(self.ids[ties])])
                held = (float(most), int(self.ids[place]), place)
            else:
                held = None
            cluster.best[group] = held
        return held

    def farthest_first(self, ka: int, kb: int, start: int) -> list[int]:
        budget, picks, at = {True: ka, False: kb}, [], start
        while True:
            picks.append(at)
            budget[bool(self.in_a[at])] -= 1
            self.add(at)
            if len(picks) >= min(ka + kb, len(self.ids)):
                return picks
            groups = [True] if budget[False] <= 0 else [False] if budget[True] <= 0 else [True, False]
            found = [b for c in self.clusters for g in groups if (b := self._best(c, g))]
            found = found or [b for c in self.clusters for g in (True, False) if (b := self._best(c, g))]
            at = max(found, key=lambda b: (b[0], -b[1]))[2]


def first_of_best(ids: np.ndarray, values: np.ndarray) -> int:
    """Position of the largest value, of the smallest id among equals."""
    best = np.flatnonzero(values == values.max())
    return int(best[np.argmin(ids[best])])

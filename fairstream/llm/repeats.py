"""Periodic runs of words by enumerating maximal pairs.

A run of period ``q`` is a maximal pair: the words from its start and those ``q`` further agree for
``length - q`` words, and neither the words before nor the words after these two agree. Pairs are
read off the tree of LCP intervals, bottom up: when two children of an interval of depth ``L``
meet, places of different children whose left words differ and that are at most ``L / 3`` apart are
the start of a run. Nothing is extended.

Only intervals of depth ``LEAST`` or more can hold such a pair, so the tree is built above places
whose first ``LEAST`` words occur again in the same text, in stretches long enough for the distance
at which they do. Each interval keeps its places in one ascending list with their left-word classes
beside it, so the nearest place of another class is a neighbour or there is none: an occurrence
between the two places of a pair would give the stretch a smaller period. Pairs at a multiple of
the smallest period end in the same stretch and lose to it.
"""

from __future__ import annotations

import itertools
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_LENGTH, MIN_EXPONENT = 6, 4
# length - period is at least MIN_LENGTH - 1 for period 1, and more for any other
LEAST = MIN_LENGTH - 1
CHUNK_WORDS = 400_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class _Numbers(dict):
    """Word -> its number in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _openings(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose first ``LEAST`` words occur twice in their text, ascending, and the class of those words."""
    count = max(0, len(words) - LEAST + 1)
    places = np.flatnonzero(np.arange(count) + LEAST <= end[:count])
    if len(places) < 2:
        return places[:0], places[:0]
    total = doc[:count].astype(np.uint64)
    for i in range(LEAST):
        total = total * _MIX[0] + words[i : i + count].astype(np.uint64)
        total ^= total >> np.uint64(29)
        total *= _MIX[1]
        total ^= total >> np.uint64(32)
    order = np.argsort(total[places], kind="stable")
    places = places[order]
    keys = total[places]
    same = keys[1:] == keys[:-1]
    twice = np.r_[False, same] | np.r_[same, False]
    places, same = places[twice], (np.r_[False, same])[twice]
    if not len(places):
        return places, places
    rows = np.stack([doc[places], *(words[places + i] for i in range(LEAST))])
    if (rows[:, 1:] != rows[:, :-1])[:, same[1:]].any():  # two openings share a hash: by the words themselves
        order = np.lexsort((places, *rows[::-1]))
        places, rows = places[order], rows[:, order]
        same = np.r_[False, (rows[:, 1:] == rows[:, :-1]).all(0)]
    classes = np.cumsum(~same)
    order = np.argsort(places)
    return places[order], classes[order]


def _near_enough(places: np.ndarray, classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which places lie in a stretch that can hold a run.

    A run of period ``q`` has at least ``4 q - LEAST + 1`` openings in a row, of which the first
    occurs again within ``q``.
    """
    order = np.argsort(classes, kind="stable")
    ahead = np.full(len(places), np.iinfo(np.int64).max)
    again = classes[order[1:]] == classes[order[:-1]]
    ahead[order[:-1][again]] = (places[order[1:]] - places[order[:-1]])[again]
    new = np.r_[True, (places[1:] != places[:-1] + 1) | (doc[places[1:]] != doc[places[:-1]])]
    starts = np.flatnonzero(new)
    length = np.diff(np.r_[starts, len(places)])
    nearest = np.minimum.reduceat(ahead, starts)
    return np.repeat(nearest <= (length + LEAST - 1) // MIN_EXPONENT, length)


def _suffixes(words: np.ndarray, doc: np.ndarray, end: np.ndarray, places: np.ndarray):
    """Places in suffix order by doubling, and how many words each shares with the one before it.

    The order is that of the words of the stretches, the last ``LEAST - 1`` of each included: what
    follows them occurs behind no equal words.
    """
    covered = np.zeros(len(words), bool)
    for i in range(LEAST):
        covered[places + i] = True
    every = np.flatnonzero(covered)
    n = len(every)
    at = np.full(len(words) + 1, -1)
    at[every] = np.arange(n)

    def later(width: int | np.ndarray, of: np.ndarray) -> np.ndarray:
        """The suffix ``width`` words on, or -1 outside the text or its stretches."""
        on = np.minimum(of + width, len(words))
        return np.where(on < end[of], at[on], -1)

    rank, levels, width = np.unique(words[every], return_inverse=True)[1], [], 1
    # texts are apart from the start
    rank = np.unique(doc[every] * n + rank, return_inverse=True)[1]
    while True:
        levels.append((width, rank))
        to = later(width, every)
        key = rank * (2 * n) + np.where(to >= 0, rank[to], n + np.arange(n))
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        width *= 2
        if int(rank.max()) == n - 1:
            break
    order = places[np.argsort(rank[at[places]])]
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        x, y = later(shared, a), later(shared, b)
        shared += np.where((x >= 0) & (y >= 0) & (rank[x] == rank[y]), width, 0)
    return order, np.where(shared >= LEAST, shared, 0)


def _pairs(order: list[int], shared: list[int], left: dict[int, int]) -> dict[tuple[int, int], int]:
    """``(start, end) -> period`` of all runs, from places in suffix order and their LCP values."""
    found: dict[tuple[int, int], int] = {}

    def pair(x: int, y: int, depth: int) -> None:
        if 3 * (y - x) <= depth and left[x] != left[y]:
            stretch = (x, y + depth)
            if found.get(stretch, depth) > y - x:
                found[stretch] = y - x

    def met(one: list[int], other: list[int], depth: int) -> list[int]:
        """Both children's places in order; neighbours of different children are judged."""
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        mine = set(small)
        if 16 * len(small) < len(large) or len(small) == 1:
            for x in small:
                k = bisect_left(large, x)
                if k and large[k - 1] not in mine:
                    pair(large[k - 1], x, depth)
                if k < len(large) and large[k] not in mine:
                    pair(x, large[k], depth)
                large.insert(k, x)
            return large
        large = sorted(large + small)
        for x, y in itertools.pairwise(large):
            if (x in mine) != (y in mine):
                pair(x, y, depth)
        return large

    open_: list[tuple[int, list[int]]] = []
    child = [order[0]]
    for place, depth in zip(order[1:], shared):
        while open_ and open_[-1][0] > depth:
            deeper, places = open_.pop()
            child = met(places, child, deeper)
        if depth:
            if open_ and open_[-1][0] == depth:
                child = met(open_.pop()[1], child, depth)
            open_.append((depth, child))
        child = [place]
    while open_:
        deeper, places = open_.pop()
        child = met(places, child, deeper)
    return found


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Texts as numbers of words -> their runs ``(start, length, period)`` by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(begin + sizes, sizes)
    places, classes = _openings(words, doc, end)
    if len(places):
        places = places[_near_enough(places, classes, doc)]
    if len(places) < 2:
        return found
    order, shared = _suffixes(words, doc, end, places)
    first = places == begin[doc[places]]
    left = dict(zip(places.tolist(), np.where(first, -1, words[places - 1]).tolist()))
    pairs = _pairs(order.tolist(), shared.tolist(), left)
    for (start, stop), period in sorted(pairs.items(), key=lambda p: (p[0][0], p[1])):
        d = int(doc[start])
        found[d].append((start - int(begin[d]), stop - start, period))
    return found


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        dropped = np.zeros(len(words), bool)
        for start, length, period in runs:
            dropped[start + period : start + length] = True
        words = list(itertools.compress(words, ~dropped))
    return b" ".join(words)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answered(held: list[tuple[object, list[bytes], np.ndarray]]) -> pa.RecordBatch:
        runs = runs_of([numbers for _, _, numbers in held])
        flat = [r for own in runs for r in own]
        ends = np.cumsum([0, *map(len, runs)])
        fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
        spans = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        kept = [_kept(words, own).decode("utf-8", "replace") for (_, words, _), own in zip(held, runs)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([doc_id for doc_id, _, _ in held], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
                pa.array(kept, pa.string()),
            ],
            ["doc_id", "runs", "collapsed"],
        )

    numbers = _Numbers()
    for batch in batches:
        held, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_py() or b"").split()  # at just the six ASCII blanks of the word definition
            own = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            held.append((doc_id, words, own))
            size += len(words)
            if size > CHUNK_WORDS:
                yield answered(held)
                held, size = [], 0
                numbers.clear()
        if held:
            yield answered(held)
        numbers.clear()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, runs, collapsed``, one row per row.

    ``runs`` holds every stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` whose smallest period is
    ``period`` (words that far apart are equal), that is at least ``max(6, 4 * period)`` words long
    and that no neighbouring word extends, by start and then period. ``collapsed`` is the text without
    the words that some run holds after its first period, joined by one space.

    Null, empty and wordless texts have no runs and an empty ``collapsed``. Texts are never cut; a
    text longer than a chunk is worked on alone, in time that grows with its length times the
    logarithm of its longest repeat. Rows with null or repeated ids are rows like any other, an
    empty table gives an empty result, and other columns are not read. Narrow: no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_found, f"doc_id bigint, runs {RUNS}, collapsed string")

"""Distances of fingerprints by bit planes and carry-save counters."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A counter of four planes: distances of 0 to 15 are told, all beyond are far.
COUNTERS = 4
PLANES_A_STEP = 16
QUERIES_A_STEP = 1024


def near_counts(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of places ``one < other`` that differ in fewer than 16 bits, and in how many, in steps.

    Plane ``i`` holds bit ``i`` of 64 fingerprints in a word. The differences of one fingerprint
    to 64 others are added plane by plane to counters that are words too; a word in which all
    counters have run over is left.
    """
    n = len(values)
    words = (n + 63) // 64
    lanes = np.arange(n) % 64
    planes = np.zeros((64, words), np.uint64)
    for i in range(64):
        bit = (values >> np.uint64(i)) & np.uint64(1)
        np.bitwise_or.at(planes[i], np.arange(n) // 64, bit << lanes.astype(np.uint64))
    filled = np.full(words, ALL)
    if n % 64:
        filled[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    for start in range(0, n, QUERIES_A_STEP):
        stop = min(start + QUERIES_A_STEP, n)
        first = start // 64
        query = np.repeat(np.arange(start, stop), words - first)
        target = np.tile(np.arange(first, words), stop - start)
        later = query // 64 <= target
        query, target = query[later], target[later]
        far = ~filled[target]
        inside = query // 64 == target  # in the own word only lanes after the own one
        own = np.uint64(1) << (query[inside] % 64).astype(np.uint64)
        far[inside] |= own | (own - np.uint64(1))
        counts = [np.zeros(len(query), np.uint64) for _ in range(COUNTERS)]
        for low in range(0, 64, PLANES_A_STEP):
            for i in range(low, low + PLANES_A_STEP):
                carry = planes[i][target] ^ (np.uint64(0) - ((values[query] >> np.uint64(i)) & np.uint64(1)))
                for k in range(COUNTERS):
                    counts[k], carry = counts[k] ^ carry, counts[k] & carry
                far |= carry
            alive = np.flatnonzero(far != ALL)
            if len(alive) < len(query):
                query, target, far = query[alive], target[alive], far[alive]
                counts = [c[alive] for c in counts]
        near = np.unpackbits((~far).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        at, lane = np.nonzero(near)
        apart = np.zeros(len(at), np.int64)
        for k in range(COUNTERS):
            apart += ((counts[k][at] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k
        yield query[at], target[at] * 64 + lane, apart

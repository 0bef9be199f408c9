"""Shards of nearly equal bytes by histogram sort.

Documents are put in order of ``(hash of the text, doc_id, row)``; equal texts are neighbours. The
boundaries are found without sorting: each round counts the exact bytes and rows below many
candidate keys in one pass over the keys, and the next candidates lie between the two keys around
each splitter's target, until the splitter's bytes are within tolerance of it. A text whose copies
reach over a splitter is refined by ``doc_id``, then by row, so no group is too large to be split.
Then every row goes straight to its part, once, with the count of rows below it already known.
"""

from __future__ import annotations

import itertools
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairstream.plans.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 40
PARTS_A_SHARD = 4
PROBES = 16
#: Allowed distance from a splitter's target, as a share of a shard.
TOLERANCE = 0.01
ROW_BYTES = 16
LOW, HIGH = -(2**63), 2**63 - 1
KEYS = ("text_key", "id_key", "row_key")
COUNTS = "context int, at int, bytes bigint, rows bigint, low bigint, high bigint"


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed amount for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


@dataclass
class Splitter:
    """A boundary on its way: the keys ``low`` to ``high`` under ``prefix`` hold its target."""

    target: float
    slack: float
    prefix: tuple[int, ...]
    low: int
    high: int
    key: tuple[int, ...] | None = None
    rows: int = 0

    def settle(self, level: int, below: tuple[int, int], upto: tuple[int, int], rows: int) -> None:
        """Judge the interval ``low`` to ``high``: bytes and rows below it, and with it."""
        under, over = self.target - below[0], upto[0] - self.target
        if rows > 1 and min(under, over) > self.slack:
            if self.low == self.high:
                self.prefix, self.low, self.high = (*self.prefix, self.low), LOW, HIGH
            return
        rest = len(KEYS) - level - 1
        if under <= over:  # all keys before ``low``: rows are numbered from zero, so none has -1
            key = (*self.prefix, self.low, *((LOW,) * (rest - 1) + (-1,) if rest else ()))
            self.key, self.rows = (key if rest else (*self.prefix, self.low - 1)), below[1]
        else:
            self.key, self.rows = (*self.prefix, self.high, *(HIGH,) * rest), upto[1]


def _counted(prefixes: list[tuple[int, ...]], probes: list[np.ndarray]):
    level = len(prefixes[0])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys and ``size`` -> for each context and interval between probes what a task holds."""
        total = [np.zeros((2, len(p) + 1), np.int64) for p in probes]
        low, high = [np.full(len(p) + 1, HIGH) for p in probes], [np.full(len(p) + 1, LOW) for p in probes]
        for batch in batches:
            *keys, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for c, prefix in enumerate(prefixes):
                mine = np.flatnonzero(np.logical_and.reduce([k == p for k, p in zip(keys, prefix)])) if prefix else slice(None)
                key, bytes_ = keys[level][mine], size[mine]
                at = np.searchsorted(probes[c], key, side="right")
                np.add.at(total[c][0], at, bytes_)
                total[c][1] += np.bincount(at, minlength=len(probes[c]) + 1)
                np.minimum.at(low[c], at, key)
                np.maximum.at(high[c], at, key)
        for c in range(len(prefixes)):
            at = np.flatnonzero(total[c][1])
            columns = [np.full(len(at), c, np.int32), at.astype(np.int32), total[c][0][at], total[c][1][at], low[c][at], high[c][at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["context", "at", "bytes", "rows", "low", "high"])

    return counts


def _probes(brackets: list[tuple[int, int]], each: int) -> np.ndarray:
    """Both ends of each bracket of keys and ``each`` evenly spaced candidates a splitter inside, ascending."""
    found: set[int] = set()
    for (low, high), n in Counter(brackets).items():
        found |= {low, high + 1, *(low + (high - low + 1) * i // (n * each + 1) for i in range(1, n * each + 1))}
    return np.array(sorted(x for x in found if LOW < x <= HIGH), np.int64)


def splitters(keyed: DataFrame, parts: int, parts_a_shard: int, probes: int, tolerance: float) -> list[Splitter]:
    """The ``parts - 1`` boundaries in order, each with the rows below it.

    Every boundary that ends a shard is within ``tolerance`` of its target, or the nearest there
    is; the boundaries between may be off by a quarter of a part. The driver holds some
    ``probes`` counts for each boundary, whatever the rows.
    """
    whole = keyed.agg(F.sum("size"), F.min(KEYS[0]), F.max(KEYS[0])).head()
    total, low, high = whole[0] or 0, whole[1], whole[2]
    if not total:
        return []
    slack = [tolerance * total * parts_a_shard if j % parts_a_shard == 0 else 0.25 * total for j in range(1, parts)]
    cuts = [Splitter(j * total / parts, s / parts, (), low, high) for j, s in enumerate(slack, 1)]
    base: dict[tuple[int, ...], tuple[int, int]] = {(): (0, 0)}
    for level in range(len(KEYS)):
        while going := [c for c in cuts if c.key is None and len(c.prefix) == level]:
            prefixes = sorted({c.prefix for c in going})
            points = [_probes([(c.low, c.high) for c in going if c.prefix == p], probes) for p in prefixes]
            rows = keyed.select(*KEYS[: level + 1], "size")
            if level:
                rows = rows.filter(F.col(KEYS[0]).isin(sorted({p[0] for p in prefixes})))
            counts = (
                rows.mapInArrow(_counted(prefixes, points), COUNTS)
                .groupBy("context", "at")
                .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
                .toArrow()
                .sort_by([("context", "ascending"), ("at", "ascending")])
            )
            context, _, bytes_, n, lows, highs = (c.to_numpy() for c in counts.columns)
            for c, prefix in enumerate(prefixes):
                mine = np.flatnonzero(context == c)
                start = base[prefix]
                upto, rows_upto = start[0] + np.cumsum(bytes_[mine]), start[1] + np.cumsum(n[mine])
                for cut in (x for x in going if x.prefix == prefix):
                    i = int(np.searchsorted(upto, cut.target, side="right"))
                    j = mine[i]
                    below = (int(upto[i - 1]), int(rows_upto[i - 1])) if i else start
                    cut.low, cut.high = int(lows[j]), int(highs[j])
                    cut.settle(level, below, (int(upto[i]), int(rows_upto[i])), int(n[j]))
                    if len(cut.prefix) > level and cut.key is None:
                        base[cut.prefix] = below
    # a loose boundary may pass the next one where single rows are larger than a part
    return list(itertools.accumulate(cuts, lambda one, other: max(one, other, key=lambda c: c.key)))


def _part_of(keys: list[tuple[int, ...]]):
    """A column function: the number of boundaries below a row's keys."""
    first = np.array([k[0] for k in keys], np.int64)
    shared = set(first.tolist())

    def parts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        from bisect import bisect_left

        for columns in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in columns]
            at = np.searchsorted(first, own[0], side="left").astype(np.int32)
            for i in np.flatnonzero(np.isin(own[0], first)).tolist() if shared else ():
                at[i] = bisect_left(keys, tuple(int(c[i]) for c in own))
            yield pa.array(at)

    parts.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(parts, "int")


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    parts_a_shard: int = PARTS_A_SHARD,
    probes: int = PROBES,
    tolerance: float = TOLERANCE,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (from 0) and ``slot`` (place in its shard, from 0), a row per row.

    Shards follow one another in the order of the keys, and each holds the same bytes but for
    ``tolerance`` of a shard at either end, or, where single documents are larger than that, up
    to the nearest boundary between documents. Copies of a text stay together unless a boundary
    falls among them. ``parts_a_shard`` tasks write each shard; raise it with the data.

    A null text has no bytes and its own hash; null and repeated ids and whole repeated rows are
    told apart by their place in the stored table and dealt like others (rows equal in all
    columns may swap places between runs, which no one can see). Columns of ``docs`` named like
    the new ones are replaced, all others are kept. An empty table gives an empty result.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "shard", "slot")]
    rows = docs.select(
        F.struct(*own).alias("doc"),
        size_of(F.col("text")).alias("size"),
        F.xxhash64("text").alias(KEYS[0]),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOW)).alias(KEYS[1]),
    )
    keyed = stored(rows.withColumn(KEYS[2], F.monotonically_increasing_id()), "shard-keys")
    parts = shards * parts_a_shard
    cuts = splitters(keyed, parts, parts_a_shard, probes, tolerance)
    keys = [c.key for c in cuts]
    ends = [0, *(c.rows for c in cuts)] if cuts else [0] * parts
    before = F.array(*(F.lit(ends[p] - ends[p - p % parts_a_shard]).cast("bigint") for p in range(parts)))
    dealt = keyed.withColumn("part", _part_of(keys)(*KEYS) if keys else F.lit(0))
    sent = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(*KEYS)
    # one part a task: the low bits number its rows
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return sent.select(
        "doc.*",
        "size",
        F.floor(F.col("part") / parts_a_shard).cast("int").alias("shard"),
        (F.get(before, F.col("part")) + place).alias("slot"),
    )

"""Frequent items of a stream prefix ``<seq bigint, item bigint>``: exact, sticky sampling and
count-min.

``seq`` is the arrival order and unique. Every threshold uses the parameter ``n``, not the
number of items seen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairstream.functions.hashing import DRAWS, PRIME, draw, hash_pairs, universal_hash
from fairstream.functions.quality import classify
from fairstream.operators.selection import kth_smallest
from fairstream.plans.storage import cut, small_table

BLOCK, LEAST_BLOCK, BLOCKS = 1 << 20, 1 << 12, 64
BROADCAST_ROWS = 100_000
MAX_SPANS = 64


@dataclass(frozen=True)
class Frequency:
    """Parameters of a run; all random choices follow from ``seed``."""

    n: int
    phi: float
    epsilon: float = 0.01
    delta: float = 0.05
    depth: int = 5
    width: int = 60
    seed: int = 0
    prime: int = PRIME

    @property
    def rate(self) -> float:
        """Expected number of sampled arrivals."""
        return math.log(1.0 / (self.delta * self.phi)) / self.epsilon

    @property
    def chance(self) -> float:
        return self.rate / self.n

    @property
    def winning(self) -> int:
        """The largest draw that wins; compared as integers, so small chances keep their size."""
        return math.floor(min(1.0, self.chance) * DRAWS)

    @property
    def sticky_threshold(self) -> float:
        return (self.phi - self.epsilon) * self.n

    @property
    def threshold(self) -> float:
        return self.phi * self.n

    @property
    def needed(self) -> int:
        """The smallest count that reaches ``phi * n``; an arrival always counts itself."""
        return max(1, math.ceil(self.threshold))

    @cached_property
    def pairs(self) -> list[tuple[int, int]]:
        return hash_pairs(self.depth, self.seed, self.prime)


def stream_prefix(items: DataFrame, n: int, dense: bool = False) -> DataFrame:
    """Exactly the first ``n`` items, by the n-th smallest ``seq``.

    ``dense`` states that ``seq`` goes 0, 1, 2, ...; then this is a pushed-down filter at once.
    """
    if dense or n <= 0:
        return items.filter(F.col("seq") < n)
    last = kth_smallest(items, "seq", n)
    return items if last is None else items.filter(F.col("seq") <= last)


def histogram(items: DataFrame) -> DataFrame:
    """``item, n``."""
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def true_frequent(items: DataFrame, run: Frequency) -> DataFrame:
    return histogram(items).filter(F.col("n") >= run.threshold)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for broadcast, if ``rows`` bounds its size and is small enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _bounded(df: DataFrame, expected: float) -> tuple[DataFrame, int]:
    """``df``, made once, and its number of rows; ``expected`` follows from the parameters."""
    if expected <= BROADCAST_ROWS:
        return small_table(df, BROADCAST_ROWS)
    kept = cut(df)
    return kept, kept.count()


def cell_rows(runs: Sequence[Frequency]) -> int:
    return sum(run.depth * run.width for run in runs)


def first_sampled(
    items: DataFrame, runs: Sequence[Frequency], key: Column | str = "seq"
) -> DataFrame:
    """``run, item, first_seq``: the arrival at which each sampled item won its coin toss.

    About ``rate`` arrivals win in each run, however long the stream is. The table is made once
    and counted: it is broadcast if it turned out small, otherwise the optimizer chooses the join.
    """
    seeds = sorted({run.seed for run in runs})
    tosses = items.select("seq", "item", *[draw(s, key).alias(f"u{i}") for i, s in enumerate(seeds)])
    verdicts = [
        F.struct(
            F.lit(number).alias("run"),
            (F.col(f"u{seeds.index(run.seed)}") <= F.lit(run.winning)).alias("won"),
        )
        for number, run in enumerate(runs)
    ]
    won = tosses.select("seq", "item", F.inline(F.array(*verdicts))).filter("won")
    firsts = won.groupBy("run", "item").agg(F.min("seq").alias("first_seq"))
    return _small(*_bounded(firsts, 2 * sum(min(run.rate, run.n) for run in runs)))


def sticky_samples(items: DataFrame, runs: Sequence[Frequency], firsts: DataFrame | None = None) -> DataFrame:
    """``run, item, n, true_freq`` for several runs at once: two scans of the items, not two per run.

    ``firsts`` is ``first_sampled`` of these runs, if it is at hand.
    """
    met = items.join(first_sampled(items, runs) if firsts is None else firsts, "item")
    since = F.count_if(F.col("seq") >= F.col("first_seq"))
    return met.groupBy("run", "item").agg(since.alias("n"), F.count(F.lit(1)).alias("true_freq"))


def sticky_sample(items: DataFrame, run: Frequency) -> DataFrame:
    """``item, n``: occurrences from the first sampled one on; earlier ones are lost."""
    return sticky_samples(items, [run]).select("item", "n")


def sticky_frequent(items: DataFrame, run: Frequency) -> DataFrame:
    return sticky_sample(items, run).filter(F.col("n") >= run.sticky_threshold)


def sample_size(items: DataFrame, run: Frequency) -> DataFrame:
    """One row ``size``: items in the sticky sample. Only the winners of the coin are counted."""
    return first_sampled(items, [run]).agg(F.count(F.lit(1)).alias("size"))


def cells(items: DataFrame, runs: Sequence[Frequency]) -> DataFrame:
    """One row per item, run and sketch row: the columns of ``items`` with ``run, r, c``.

    The coefficients come as one constant array, so the generated code does not grow with the
    number of sketches.
    """
    family = ", ".join(
        f"named_struct('run', {number}, 'r', {r}, 'a', {a}, 'b', {b}, 'w', {run.width}, 'p', {run.prime})"
        for number, run in enumerate(runs)
        for r, (a, b) in enumerate(run.pairs)
    )
    spread = items.select("*", F.expr(f"inline(array({family}))"))
    cell = universal_hash("item", *map(F.col, "abwp"))
    return spread.select(*items.columns, "run", "r", cell.alias("c"))


def countmin_matrix(items: DataFrame, run: Frequency) -> DataFrame:
    """``r, c, n``: the nonzero cells, at most depth * width rows."""
    return cells(items.select("item"), [run]).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))


def _block(runs: Sequence[Frequency]) -> int:
    return min(BLOCK, max(LEAST_BLOCK, max(run.n for run in runs) // BLOCKS))


def cell_counts(items: DataFrame, runs: Sequence[Frequency], block: int | None = None) -> DataFrame:
    """``run, r, c, block, count``: arrivals in each cell by blocks of ``block`` consecutive ``seq``."""
    blocked = items.select("item", F.expr(f"seq div {block or _block(runs)}L").alias("block"))
    return cells(blocked, runs).groupBy("run", "r", "c", "block").count()


def cell_crossings(
    items: DataFrame,
    runs: Sequence[Frequency],
    before: DataFrame | None = None,
    block: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``run, r, c, seq``: the arrival at which a cell's count reaches ``needed`` of its run.

    Cells are counted by blocks of ``block`` consecutive ``seq``; a running sum over this small
    table finds the one block in which a cell crosses. These blocks, at most
    ``depth * width`` a run, are kept as a table and become ``seq`` ranges, so the second scan
    reads little, and only their arrivals in crossing cells are ranked. No window holds more
    than ``block`` arrivals. By default a block is a part of ``n``, between ``LEAST_BLOCK`` and
    ``BLOCK`` arrivals; its size does not change the result.

    ``before`` (``run, r, c, n``) are counts carried over from earlier arrivals; ``sizes`` is
    ``cell_counts`` of these items, if it is at hand.
    """
    cell = ["run", "r", "c"]
    block = block or _block(runs)
    blocked = items.select("seq", "item", F.expr(f"seq div {block}L").alias("block"))
    sizes = cell_counts(items, runs, block) if sizes is None else sizes
    so_far = F.sum("count").over(Window.partitionBy(*cell).orderBy("block"))
    upto = sizes.withColumn("upto", so_far)
    if before is not None:
        start = before.select(*cell, F.col("n").alias("start"))
        upto = upto.join(_small(start, cell_rows(runs)), cell, "left")
        upto = upto.withColumn("upto", F.col("upto") + F.coalesce("start", F.lit(0)))
    needed = F.array(*[F.lit(run.needed).cast("bigint") for run in runs])[F.col("run")]
    edge = (
        upto.withColumn("nth", needed - F.col("upto") + F.col("count"))
        .filter((F.col("nth") > 0) & (F.col("nth") <= F.col("count")))
        .select(*cell, "block", "nth")
    )
    edge, rows = _bounded(edge, cell_rows(runs))
    if rows <= BROADCAST_ROWS:
        near = blocked.filter(_in_blocks(edge, block))
    else:
        near = blocked.join(edge.select("block").distinct(), "block", "left_semi")
    ranked = (
        cells(near, runs)
        .join(_small(edge, rows), [*cell, "block"])
        .withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("seq")))
    )
    return ranked.filter("rank = nth").select(*cell, "seq")


def _in_blocks(edge: DataFrame, block: int) -> Column:
    """Whether ``seq`` lies in one of the blocks of ``edge``, as ranges the scan can skip by."""
    spans: list[list[int]] = []
    # a bounded table, mostly a literal one that is read without a job
    for number in sorted({row.block for row in edge.select("block").collect()}):
        if spans and number == spans[-1][1] + 1:
            spans[-1][1] = number
        else:
            spans.append([number, number])
    if not spans:
        return F.lit(False)
    inside = F.lit(False)
    if len(spans) <= MAX_SPANS:
        for low, high in spans:
            inside = inside | F.col("seq").between(*_span(low, high, block))
        return inside
    listed = F.col("block").isin([b for low, high in spans for b in range(low, high + 1)])
    return listed & F.col("seq").between(*_span(spans[0][0], spans[-1][1], block))


def _span(low: int, high: int, block: int) -> tuple[int, int]:
    """First and last ``seq`` of blocks low..high; block 0 reaches to both sides of zero."""
    first = low * block - (block - 1 if low <= 0 else 0)
    last = high * block + (block - 1 if high >= 0 else 0)
    return max(first, -(2**63)), min(last, 2**63 - 1)


def countmin_frequents(
    items: DataFrame, runs: Sequence[Frequency], block: int | None = None
) -> DataFrame:
    """``run, item, n`` (true count) of the items the online sketches report.

    An item is reported if its estimate reaches ``phi * n`` at one of its arrivals. Cells only
    grow, so this is decided at the last arrival: each of its cells must have crossed by then.
    """
    seen = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))
    crossed = cell_crossings(items, runs, block=block).withColumnRenamed("seq", "crossed_at")
    return full_items(
        cells(seen, runs)
        .join(_small(crossed, cell_rows(runs)), ["run", "r", "c"])
        .filter("crossed_at <= last_seq"),
        runs,
    )


def full_items(crossed: DataFrame, runs: Sequence[Frequency]) -> DataFrame:
    """Items with all their cells among ``run, item, n`` rows of crossed cells."""
    depth = F.array(*[F.lit(run.depth) for run in runs])[F.col("run")]
    return (
        crossed.groupBy("run", "item")
        .agg(F.count(F.lit(1)).alias("cells"), F.first("n").alias("n"))
        .filter(F.col("cells") == depth)
        .select("run", "item", "n")
    )


def countmin_frequent(items: DataFrame, run: Frequency, block: int | None = None) -> DataFrame:
    """``item, n`` for a single run."""
    return countmin_frequents(items, [run], block).drop("run")


def returned_total(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def report(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``item, true_freq`` of every reported item, ascending; ``truth`` is the histogram."""
    true_freq = truth.select("item", F.col("n").alias("true_freq"))
    return found.select("item").join(true_freq, "item").orderBy("item")


def quality_counts(reported: DataFrame, runs: Sequence[Frequency]) -> DataFrame:
    """``run, frequent, almost, rare, total`` from ``run, item, true_freq`` of reported items.

    Each run is graded with its own parameters. A run that reported nothing has no row.
    """
    kind = F.lit(None)
    for number, run in enumerate(runs):
        mine = classify("true_freq", run.n, run.phi, run.epsilon)
        kind = F.when(F.col("run") == number, mine).otherwise(kind)
    graded = reported.withColumn("kind", kind)
    return graded.groupBy("run").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("frequent", "almost", "rare")],
        F.count(F.lit(1)).alias("total"),
    )


def quality_averages(counts: DataFrame) -> DataFrame:
    """Averages over runs: ``algorithm, param, frequent, almost, rare, size``."""
    return counts.groupBy("algorithm", "param").agg(
        *[F.avg(c).alias(c) for c in ("frequent", "almost", "rare", "size")]
    )

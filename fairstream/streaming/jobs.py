"""Structured Streaming jobs: distinct items, and frequent items of a stream prefix.

Arrival order is the micro-batch number, then ``seq`` within the batch. The bounded trigger
ends a job with its input; a job also ends once it has its fill.
"""

from __future__ import annotations

from threading import Event, Thread

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairstream.operators.frequency import (
    BROADCAST_ROWS,
    Frequency,
    cell_counts,
    cell_crossings,
    cell_rows,
    cells,
    first_sampled,
    full_items,
)
from fairstream.operators.selection import kth_smallest
from fairstream.streaming.state import BatchState

DISTINCT = {"items": "item bigint"}
FREQUENCY = {
    "items": "item bigint, n bigint, last_seq bigint, sticky bigint",
    "matrix": "r int, c int, n bigint",
    "crossings": "r int, c int, seq bigint",
}


def fold_items(rows: DataFrame) -> DataFrame:
    """One row an item for all batches: its count, its last batch and arrival, its sticky count if it was sampled."""
    earlier = Window.partitionBy("item").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("s", F.when(F.count("sticky").over(earlier) > 0, F.col("n")).otherwise(F.col("sticky")))
    last = F.max_by(F.struct("last_seq", "batch_id"), "batch_id")
    folded = counted.groupBy("item").agg(F.sum("n").alias("n"), last.alias("last"), F.sum("s").alias("sticky"))
    return folded.select("item", "n", "last.last_seq", "sticky", "last.batch_id")


def last_batch(rows: DataFrame) -> DataFrame:
    """Running totals: those of the last batch are all there is."""
    newest = rows.agg(F.max("batch_id").alias("newest"))
    return rows.filter(F.col("batch_id") == newest.scalar())


def first_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item").agg(F.min("batch_id").alias("batch_id"))


DISTINCT_FOLDS = {"items": first_seen}
FREQUENCY_FOLDS = {"items": fold_items, "matrix": last_batch}


def _frequency_state(spark: SparkSession, root: str) -> BatchState:
    return BatchState(spark, root, FREQUENCY, FREQUENCY_FOLDS)


def streaming_histogram(items: DataFrame) -> DataFrame:
    """Native streaming aggregation ``item, n`` for complete or update mode."""
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def streaming_distinct(items: DataFrame) -> DataFrame:
    """Native streaming deduplication, append mode."""
    return items.select("item").dropDuplicates(["item"])


def _start(items: DataFrame, update, checkpoint: str, trigger: dict | None, full: Event) -> StreamingQuery:
    """Start a job that ends with its input or once ``full`` is set, also on an endless source.

    A batch cannot stop its own query, so a thread does. Should a further batch begin before
    that, it does nothing; should the stop cut off a batch that is done, it is done when run again.
    """
    writer = items.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    query = writer.trigger(**(trigger or {"availableNow": True})).start()

    def watch() -> None:
        while query.isActive:
            if full.wait(0.1):
                query.stop()
                return

    Thread(target=watch, daemon=True).start()
    return query


# distinct items


def start_distinct(
    items: DataFrame, root: str, checkpoint: str, threshold: int, trigger: dict | None = None
) -> StreamingQuery:
    """Distinct items of whole batches, taken while fewer than ``threshold`` items came."""
    state = BatchState(items.sparkSession, root, DISTINCT, DISTINCT_FOLDS)

    full = Event()

    def update(batch: DataFrame, batch_id: int) -> None:
        if not full.is_set() and update_distinct(state, batch, batch_id, threshold) >= threshold:
            full.set()

    return _start(items, update, checkpoint, trigger, full)


def update_distinct(state: BatchState, batch: DataFrame, batch_id: int, threshold: int) -> int:
    """The items taken so far, with those of this batch; a batch after the last one taken leaves nothing."""
    _, total = state.last_before(batch_id + 1 if state.is_folded(batch_id) else batch_id)
    if total >= threshold or state.is_folded(batch_id):
        return total
    # one aggregation gives the distinct items and, as the sum of their counts, the batch size
    counted = batch.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        state.write("items", batch_id, counted.select("item"))
        size = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
        state.commit(batch_id, size, total + size)
        state.compact_if_due(batch_id)
        return total + size
    finally:
        counted.unpersist()


def stream_distinct_items(spark: SparkSession, root: str) -> DataFrame:
    return BatchState(spark, root, DISTINCT, DISTINCT_FOLDS).committed("items").select("item").distinct()


def stream_distinct_report(spark: SparkSession, root: str) -> DataFrame:
    """One row ``items, distinct_items, largest``."""
    state = BatchState(spark, root, DISTINCT, DISTINCT_FOLDS)
    seen = state.sizes().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("items"))
    found = state.committed("items").agg(
        F.countDistinct("item").alias("distinct_items"), F.max("item").alias("largest")
    )
    return found.select(seen.scalar().alias("items"), "distinct_items", "largest")


# frequent items


def start_frequency(
    items: DataFrame, root: str, checkpoint: str, run: Frequency, trigger: dict | None = None
) -> StreamingQuery:
    """Histogram, sticky sample and count-min of exactly the first ``run.n`` items.

    Without a ``seq`` column the order of arrival is that of the source's files and their lines.
    """
    state = _frequency_state(items.sparkSession, root)

    full = Event()

    def update(batch: DataFrame, batch_id: int) -> None:
        if not full.is_set() and update_frequency(state, batch, batch_id, run) >= run.n:
            full.set()

    return _start(items, update, checkpoint, trigger, full)


def update_frequency(state: BatchState, batch: DataFrame, batch_id: int, run: Frequency) -> int:
    """The items taken so far, with those of this batch; a batch after the last one taken leaves nothing."""
    previous, total = state.last_before(batch_id + 1 if state.is_folded(batch_id) else batch_id)
    if total >= run.n or state.is_folded(batch_id):
        return total
    if "seq" in batch.columns:
        toss = F.col("seq").cast("string")
        batch = batch.select("seq", "item")
    else:
        toss = F.concat(F.lit(f"{batch_id}:"), F.col("seq").cast("string"))
        line = F.monotonically_increasing_id()  # rises within a split
        if "arrival" in batch.columns:
            batch = batch.select("arrival.*", line.alias("line"), "item")
        else:
            batch = batch.select(line.alias("seq"), "item")
    held = batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if "line" in batch.columns:
            batch = in_order(batch)
        size, room = batch.count(), run.n - total
        if size > room:
            kept, size = batch.filter(F.col("seq") <= kth_smallest(batch, "seq", room)), room
        else:
            kept = batch
        # one count of the cells, by blocks, serves the matrix and the search for crossings
        counted = cell_counts(kept, [run]).persist(StorageLevel.MEMORY_AND_DISK)
        # matrix rows are running totals: a batch reads the last one only
        before = state.read_batch("matrix", previous)

        def items() -> DataFrame:
            firsts = first_sampled(kept, [run], toss)
            since = (F.col("seq") >= F.col("first_seq")).cast("bigint")
            return (
                kept.join(firsts, "item", "left")
                .groupBy("item")
                .agg(
                    F.count(F.lit(1)).alias("n"),
                    F.max("seq").alias("last_seq"),
                    # NULL unless the item was sampled in this batch
                    F.sum(since).alias("sticky"),
                )
            )

        def matrix() -> DataFrame:
            now = before.unionByName(counted.select("r", "c", F.col("count").alias("n")))
            return now.groupBy("r", "c").agg(F.sum("n").alias("n"))

        def crossings() -> DataFrame:
            return cell_crossings(kept, [run], before.withColumn("run", F.lit(0)), sizes=counted).drop("run")

        try:
            state.write_all(batch_id, items=items, matrix=matrix, crossings=crossings)
        finally:
            counted.unpersist()
        state.commit(batch_id, size, total + size)
        state.compact_if_due(batch_id)
        return total + size
    finally:
        held.unpersist()


def in_order(lines: DataFrame) -> DataFrame:
    """``time, path, split, line, item`` -> ``seq, item``, dense from 0: by time and path of the file, then by line.

    Lines are numbered within their split, splits by a running sum over their few counts, so
    the numbers do not depend on how files are split or packed into tasks.
    """
    split = ["time", "path", "split"]
    sizes = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("size"), F.min("line").alias("first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first"))
    placed = lines.join(starts.select(*split, "start"), split)
    return placed.select((F.col("start") + F.col("line")).alias("seq"), "item")


def stream_histogram(spark: SparkSession, root: str) -> DataFrame:
    partials = _frequency_state(spark, root).committed("items")
    return partials.groupBy("item").agg(F.sum("n").alias("n"))


def stream_true_frequent(spark: SparkSession, root: str, run: Frequency) -> DataFrame:
    return stream_histogram(spark, root).filter(F.col("n") >= run.threshold)


def stream_sticky_sample(spark: SparkSession, root: str) -> DataFrame:
    """``item, n``: the batch that first sampled an item counts in part, later ones in full."""
    partials = _frequency_state(spark, root).committed("items")
    earlier = (
        Window.partitionBy("item").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    sampled_before = F.count("sticky").over(earlier) > 0
    counted = partials.withColumn("s", F.when(sampled_before, F.col("n")).otherwise(F.col("sticky")))
    return counted.groupBy("item").agg(F.sum("s").alias("n")).filter("n is not null")


def stream_sticky_frequent(spark: SparkSession, root: str, run: Frequency) -> DataFrame:
    return stream_sticky_sample(spark, root).filter(F.col("n") >= run.sticky_threshold)


def stream_countmin_frequent(spark: SparkSession, root: str, run: Frequency) -> DataFrame:
    """``item, n`` as in the batch form: all cells of an item crossed by its last arrival."""
    state = _frequency_state(spark, root)
    seen = state.committed("items").groupBy("item").agg(
        F.sum("n").alias("n"),
        F.max("batch_id").alias("last_batch"),
        F.max_by("last_seq", "batch_id").alias("last_seq"),
    )
    crossed = state.committed("crossings").withColumnRenamed("seq", "crossed_at")
    by_then = "batch_id < last_batch or (batch_id = last_batch and crossed_at <= last_seq)"
    if cell_rows([run]) <= BROADCAST_ROWS:
        crossed = F.broadcast(crossed)
    reached = cells(seen, [run]).join(crossed, ["r", "c"])
    return full_items(reached.filter(by_then), [run]).drop("run")


def stream_batch_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``batch_id, size`` of nonempty batches of either job."""
    return BatchState(spark, root, {}).sizes()

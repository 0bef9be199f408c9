"""Run records from experiment logs, and statistics over them.

Log lines come as ``file, chunk, line, value``: within a file they are ordered by
``(chunk, line)``, and a chunk is a bounded stretch of a file (an input split).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairstream.plans.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: the formats of the log files and of their names
VERSION = r"combined_logs_(.*?)\.txt"
HEADER = r"===\s*FILE:\s*.*?_(\d+)\.log\s*==="
CONFIG = r"File path = (.*?), KA = (\d+), KB = (\d+), L = (\d+)"
DATASET = r"Artificial(.*?)\.csv"
OBJECTIVE = r"Objective function = ([\d\.]+)"
RUNTIME = r"Running time of MRFairFFT = (\d+) ms"


def _found(source: Column | str, pattern: str, group: int = 1) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    return F.when(F.regexp_like(source, F.lit(pattern)), F.regexp_extract(source, pattern, group))


def log_version(file: Column | str) -> Column:
    """By the name of the file; the folders it is in do not count."""
    name = F.element_at(F.split(F.col(file) if isinstance(file, str) else file, "/", -1), -1)
    return F.coalesce(_found(name, VERSION), F.lit("unknown"))


def log_marks(lines: DataFrame) -> DataFrame:
    """Only the lines that matter, with ``workers, config, objective`` or ``runtime_ms`` set.

    A line counts as the first kind it matches.
    """
    kind = (
        F.when(F.regexp_like("value", F.lit(HEADER)), "header")
        .when(F.regexp_like("value", F.lit(CONFIG)), "config")
        .when(F.regexp_like("value", F.lit(OBJECTIVE)), "objective")
        .when(F.regexp_like("value", F.lit(RUNTIME)), "runtime")
    )
    path = F.regexp_extract("value", CONFIG, 1)
    config = F.struct(
        F.coalesce(_found(path, DATASET), path).alias("dataset"),
        F.regexp_extract("value", CONFIG, 2).alias("ka"),
        F.regexp_extract("value", CONFIG, 3).alias("kb"),
        F.regexp_extract("value", CONFIG, 4).cast("int").alias("l"),
    )
    # most lines of a log list centers; a plain substring test spares them the patterns
    likely = F.lit(False)
    for key in ("FILE:", "File path = ", "Objective function = ", "Running time of "):
        likely = likely | F.col("value").contains(key)
    marks = lines.filter(likely).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    is_kind = lambda k: F.col("kind") == k
    return marks.select(
        "file",
        "chunk",
        "line",
        F.when(is_kind("header"), F.regexp_extract("value", HEADER, 1).cast("int")).alias("workers"),
        F.when(is_kind("config"), config).alias("config"),
        F.when(
            is_kind("objective"), F.regexp_extract("value", OBJECTIVE, 1).cast("double")
        ).alias("objective"),
        F.when(
            is_kind("runtime"), F.regexp_extract("value", RUNTIME, 1).cast("bigint")
        ).alias("runtime_ms"),
    )


# What a reader of the lines has in hand, as a number: 4 with workers, 2 with a data set, 1 with an
# objective. A runtime line that finds all three is a record and takes the last two away.
WHOLE, HEADER_BIT, CONFIG_BIT, OBJECTIVE_BIT = 7, 4, 2, 1
STATES = range(WHOLE + 1)


def _next_state(kind: str, state: int) -> int:
    if kind == "runtime":
        return HEADER_BIT if state == WHOLE else state
    if kind == "no_dataset":
        return state & ~CONFIG_BIT
    return state | {"header": HEADER_BIT, "config": CONFIG_BIT, "objective": OBJECTIVE_BIT}[kind]


def _chunk_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``file, chunk, line, kind`` -> ``file, chunk, effect``: the state after a chunk for each one before it."""
    at, effect = None, list(STATES)

    def told() -> pa.RecordBatch:
        rows = [] if at is None else [{"file": at[0], "chunk": at[1], "effect": effect}]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("chunk", pa.int64()), ("effect", pa.list_(pa.int32()))]))

    for batch in batches:
        for file, chunk, _, kind in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, chunk) != at:
                yield told()
                at, effect = (file, chunk), list(STATES)
            effect = [_next_state(kind, s) for s in effect]
    yield told()


def _chunk_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``file, chunk, effect`` -> ``file, chunk, state`` before the chunk; effects are composed in order."""
    own, state = None, 0
    for batch in batches:
        states = []
        for file, _, effect in zip(*(c.to_pylist() for c in batch.columns)):
            if file != own:
                own, state = file, 0
            states.append(state)
            state = effect[state]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(states, pa.int32())], ["file", "chunk", "state"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``file, chunk, line, kind, state, run`` -> the ``run`` of the lines that are records."""
    at, state = None, 0
    for batch in batches:
        kept = []
        for file, chunk, _, kind, start in zip(*(c.to_pylist() for c in batch.columns[:5])):
            if (file, chunk) != at:
                at, state = (file, chunk), start
            kept.append(kind == "runtime" and state == WHOLE)
            state = _next_state(kind, state)
        rows = batch.column(5).filter(pa.array(kept, pa.bool_()))
        yield pa.RecordBatch.from_arrays([rows], ["run"])


def run_records(lines: DataFrame) -> DataFrame:
    """``version, dataset, workers, l, runtime_ms, ka, kb, objective``, one row per finished run.

    A runtime line is a record if the file has a header before it and, since the last record, a
    configuration whose data set has a name and an objective; it takes the last of each. A
    runtime line that is no record takes nothing away, also in malformed logs. A configuration
    with an empty name stands for none.

    No task needs a whole file: the values are carried inside each chunk and then over chunks, and
    what a chunk does to a reader is a function of eight states, worked out chunk by chunk and
    composed over the chunks of a file (one short row each). The few lines that matter are parsed
    once and kept as a table.
    """
    named = F.col("config.dataset") != ""
    kind = F.when(F.col("workers").isNotNull(), "header").when(F.col("config").isNotNull(), F.when(named, "config").otherwise("no_dataset"))
    kind = kind.when(F.col("objective").isNotNull(), "objective").otherwise("runtime")
    marks = stored(log_marks(lines).withColumn("kind", kind), "marks")
    by_line = ["file", "chunk", "line"]
    effects = marks.select(*by_line, "kind").repartition("file", "chunk").sortWithinPartitions(*by_line)
    effects = effects.mapInArrow(_chunk_effects, "file string, chunk bigint, effect array<int>")
    composed = effects.repartition("file").sortWithinPartitions("file", "chunk")
    states = composed.mapInArrow(_chunk_starts, "file string, chunk bigint, state int")

    carried = ("workers", "config", "objective")
    up_to_line = Window.partitionBy("file", "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier_chunks = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    lasts = marks.groupBy("file", "chunk").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c) for c in carried)
    )
    before = [F.last(c, ignorenulls=True).over(earlier_chunks).alias(f"{c}_before") for c in carried]
    starts = lasts.select("file", "chunk", *before).join(states, ["file", "chunk"])
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(up_to_line), F.col(f"{c}_before")).alias(c)
    run = F.struct("file", *map(last, carried), "runtime_ms").alias("run")
    told = marks.join(starts, ["file", "chunk"]).select(*by_line, "kind", "state", run)
    told = told.repartition("file", "chunk").sortWithinPartitions(*by_line)
    runs = told.mapInArrow(_finished, f"run {told.schema['run'].dataType.simpleString()}")
    return runs.select(
        log_version("run.file").alias("version"),
        "run.config.dataset",
        "run.workers",
        "run.config.l",
        "run.runtime_ms",
        "run.config.ka",
        "run.config.kb",
        "run.objective",
    )


def objective_statistics(records: DataFrame) -> DataFrame:
    """Mean and sample deviation of the objective; the deviation of a single run is 0."""
    return records.groupBy("version", "dataset", "ka", "kb", "l").agg(
        F.avg("objective").alias("mean_objective"),
        F.coalesce(F.stddev_samp("objective"), F.lit(0.0)).alias("std_objective"),
    )


def runtime_statistics(records: DataFrame, how: str = "avg") -> DataFrame:
    """Mean (``avg``) or minimum (``min``) runtime by configuration and workers."""
    if how not in ("avg", "min"):
        raise ValueError(f"how must be avg or min, not {how!r}")
    value = F.avg("runtime_ms") if how == "avg" else F.min("runtime_ms").cast("double")
    return records.groupBy("version", "dataset", "workers", "l", "ka", "kb").agg(
        value.alias("runtime_ms")
    )

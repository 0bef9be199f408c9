"""Where intermediate tables live, and how lineage is cut.

Everything goes to the shared folder the cluster names in ``spark.checkpoint.dir``. Only a
local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="fairstream-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Paths given out in this process and not yet cleared.
_given_out: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, there until ``clear_scratch``."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given_out.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder of the shared store holds; nothing if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def clear_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables this process has written, from the ``since``-th on; how many they were.

    Results are lazy and read them, so this is for after a result is written or collected.
    Checkpoints are Spark's own (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    paths = _given_out[since:]
    for path in paths:
        remove(spark, path)
    del _given_out[since:]
    return len(paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a large intermediate as Parquet and read it back: columnar, prunable, no lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small intermediate (centers, per-part state)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``df`` and its number of rows; up to ``rows`` rows it becomes a literal table of the plan.

    For results that their parameters keep small. A larger one is checkpointed and counted.
    """
    found = df.limit(rows + 1).toArrow()
    if found.num_rows <= rows:
        return df.sparkSession.createDataFrame(found, df.schema), found.num_rows
    kept = cut(df)
    return kept, kept.count()


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` in memory with spill to disk while the block runs."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()

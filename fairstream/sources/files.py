"""Text sources and the summary sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairstream.functions.parsing import parse_points
from fairstream.plans.storage import cut

SUMMARY = ("frequent", "almost", "rare", "size")


BROADCAST_ROWS = 100_000


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``path, split, line`` and other columns -> the others with ``id``, the line number from 0.

    ``line`` rises within each input split, ``split`` is its first byte. Files follow one another by
    path. Lines are counted by split, splits summed up inside their file and files by their
    totals, so the numbers do not depend on how files are split or packed into tasks.
    """
    sizes = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("size"), F.min("line").alias("first"))
    sizes = cut(sizes)
    files = sizes.groupBy("path").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("path", F.coalesce(before, F.lit(0)).alias("files_before"))
    inside = F.sum("size").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(files, "path")
    starts = starts.select("path", "split", (F.col("files_before") + F.col("inside") - F.col("first")).alias("start"))
    small = F.broadcast(starts) if sizes.count() <= BROADCAST_ROWS else starts
    others = [c for c in lines.columns if c not in ("path", "split", "line")]
    return lines.join(small, ["path", "split"]).select((F.col("start") + F.col("line")).alias("id"), *others)


def read_points(spark: SparkSession, path: str, drop_blank: bool = False) -> DataFrame:
    """``id, coords, label`` from lines ``x1,...,xD,label`` of a file or directory.

    ``id`` is the number of the line from 0, over the files in order of their paths, whatever the
    size of the input splits. Numbering takes one pass that only counts lines.
    """
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split")]
    lines = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("line"), "value")
    return parse_points(numbered_lines(lines), drop_blank)


def read_docs(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """``doc_id, value``, one document per line, spread over ``parts`` partitions if given."""
    docs = spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), "value")
    return docs.repartition(parts) if parts else docs


def read_run_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, chunk, line, value`` of all logs that match; empty if none does.

    A log is a file, or a folder ``file=name`` of files in order of their paths, as a partitioned
    write leaves it; ``chunk`` numbers the splits of a log in order.
    """
    try:
        lines = spark.read.text(pattern)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, chunk bigint, line bigint, value string")
    path, parted = F.col("_metadata.file_path"), F.regexp_extract("_metadata.file_path", "/file=([^/]+)/[^/]+$", 1)
    lines = lines.select(
        F.when(parted != "", parted).otherwise(path).alias("file"),
        path.alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    splits = cut(lines.select("file", "path", "split").distinct())
    order = Window.partitionBy("file").orderBy("path", "split")
    chunks = splits.select("path", "split", (F.row_number().over(order) - 1).cast("bigint").alias("chunk"))
    small = F.broadcast(chunks) if splits.count() <= BROADCAST_ROWS else chunks
    return lines.join(small, ["path", "split"]).select("file", "chunk", "line", "value")


def write_summary(averages: DataFrame, path: str) -> None:
    """Averages with two decimals as CSV with a header, one directory per algorithm."""
    rounded = averages.select(
        "algorithm", "param", *[F.format_string("%.2f", c).alias(c) for c in SUMMARY]
    )
    rounded.write.partitionBy("algorithm").mode("overwrite").csv(path, header=True)

"""Streaming sources of items. Any other streaming DataFrame of that shape serves as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairstream.functions.parsing import parse_items

ITEMS = "seq bigint, item bigint"


def read_item_stream(
    spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Items from files as they arrive, oldest first.

    ``parquet`` carries ``seq, item``. ``text`` has one integer a line and no ``seq``; its
    ``arrival`` says where a line comes from: modification time and path of its file, and the
    start of its split.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if format == "text":
        arrival = F.struct(
            F.col("_metadata.file_modification_time").alias("time"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
        )
        return parse_items(reader.text(path).select("value", arrival.alias("arrival")))
    return reader.schema(ITEMS).format(format).load(path)

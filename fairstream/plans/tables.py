"""Views of the driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairstream.functions.parsing import split_lines

LOG_CHUNK = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores.

    An input that already has a partition per core, as any large one does, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points with whole-number coordinates; open orders are group ``A``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.array(
            F.col("o_custkey").cast("double"),
            F.floor("o_totalprice").cast("double"),
            F.month("o_orderdate").cast("double"),
        ).alias("coords"),
        F.when(F.col("o_orderstatus") == "O", "A").otherwise(F.col("o_orderstatus")).alias("label"),
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("coords"),
        F.when(F.col("label") < 5, "A").otherwise("B").alias("label"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line, value``: a line of a text is a document."""
    return split_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, item``; some items are negative."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.floor("value") - 20).alias("item")
    )


def event_batches(spark: SparkSession, sf_dir: str, size: int = 750) -> DataFrame:
    """``batch, item``: events in batches of ``size``."""
    return event_items(spark, sf_dir).select(F.expr(f"seq div {size}L").alias("batch"), "item")


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, chunk, line, value``: every order as one run in an experiment log.

    One order in three opens a new header, one in seven breaks off with a traceback. Some lack the
    configuration or the objective before their runtime, or have a data set without a name.
    """
    key = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[p.cast("string") for p in parts])
    customer = F.pmod("o_custkey", F.lit(4))
    file = F.when(customer == 3, "other.txt").otherwise(
        text(F.lit("combined_logs_v"), customer, F.lit(".txt"))
    )
    path = text(
        F.when(F.col("o_orderstatus") == "P", "plain_").otherwise("Artificial"),
        F.when(F.pmod(key, F.lit(17)) == 6, "").otherwise(F.col("o_orderpriority")),
        F.lit(".csv"),
    )
    crashed = F.pmod(key, F.lit(7)) == 3
    workers = F.element_at(F.array(*map(F.lit, (2, 4, 8, 16))), (F.pmod(key, F.lit(4)) + 1).cast("int"))
    lines = [
        F.when(F.pmod(key, F.lit(3)) == 0, text(F.lit("=== FILE: run_"), workers, F.lit(".log ==="))),
        F.when(
            F.pmod(key, F.lit(13)) != 4,
            text(F.lit("File path = "), path, F.lit(", KA = "), F.pmod(key, F.lit(2)) + 7, F.lit(", KB = 2, L = 16")),
        ),
        F.when(crashed, "Traceback (most recent call last):"),
        F.when(~crashed & (F.pmod(key, F.lit(11)) != 5), text(F.lit("Objective function = "), F.floor("o_totalprice") / 8)),
        F.when(
            ~crashed,
            text(F.lit("Running time of MRFairFFT = "), F.floor("o_totalprice"), F.lit(" ms")),
        ),
    ]
    orders = table(spark, sf_dir, "orders").drop("o_orderdate")
    return (
        spread(orders)
        .select(
            file.alias("file"),
            F.expr(f"o_orderkey div {LOG_CHUNK}L").alias("chunk"),
            key,
            F.posexplode(F.array(*lines)).alias("place", "value"),
        )
        .filter(F.col("value").isNotNull())
        .select("file", "chunk", (key * 8 + F.col("place")).alias("line"), "value")
    )


def write_logs(lines: DataFrame, folder: str) -> None:
    """Each ``file`` of ``lines`` as a folder of text files whose names follow the order of the lines.

    One range exchange sorts all logs at once; a long log becomes many files.
    """
    keys = ["file", "chunk", "line"]
    dealt = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.select("file", "value").write.partitionBy("file").text(folder)


def write_in_order(lines: DataFrame, key: str, folder: str, most_lines: int) -> None:
    """``value`` of all rows as text files whose paths follow ``key``, by ranges, and of one modification time."""
    dealt = lines.repartitionByRange(key).sortWithinPartitions(key)
    dealt.select("value").write.option("maxRecordsPerFile", most_lines).text(folder)
    spark = lines.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    written = [f for f in files.listStatus(at) if f.getPath().getName().startswith("part-")]
    for file in written:
        files.setTimes(file.getPath(), written[0].getModificationTime(), -1)

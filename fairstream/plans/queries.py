"""The registered queries: each operator over whole tables. ``oracles`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairstream.functions.distance import squared_distance
from fairstream.functions.hashing import coin, hash_pairs, universal_hash
from fairstream.functions.parsing import parse_items, parse_points, tokens
from fairstream.functions.quality import classify
from fairstream.operators import distinct as ds
from fairstream.operators import frequency as fq
from fairstream.operators import runs, words
from fairstream.operators.kcenter import dealt, fair_fft, fair_fft_lazy, local_centers, mr_fair_fft
from fairstream.operators.points import label_counts, with_part
from fairstream.operators.radius import nearest_center, objective
from fairstream.operators.selection import kth_smallest
from fairstream.plans import experiments as ex
from fairstream.plans import tables as tb
from fairstream.plans.storage import scratch_path
from fairstream.sources.files import read_docs, read_points, read_run_logs, write_summary
from fairstream.sources.streams import read_item_stream
from fairstream.streaming import jobs
from fairstream.streaming.keyed import keyed_state, streaming_sticky_sample
from fairstream.streaming.state import BatchState

KA, KB, PARTS = 4, 3, 8
PHI, EPSILON, DELTA, DEPTH, WIDTH, SEED = 0.018, 0.004, 0.05, 5, 60, 7
EPSILONS, WIDTHS, CLASS_EPSILON, SEEDS = (0.004, 0.006, 0.009), (40, 60, 80), 0.006, (1, 2, 3)
LINE_KEYS = ("doc_id", "line")
STREAM_CUTS = 4

Query = Callable[[SparkSession, str], DataFrame]


def frequency_run(n: int) -> fq.Frequency:
    return fq.Frequency(n, PHI, EPSILON, DELTA, DEPTH, WIDTH, SEED)


def prefix_length(total: int) -> int:
    """Four fifths of the stream, which ends inside a batch."""
    return total * 4 // 5


def _flat(centers: DataFrame, *keys: str) -> DataFrame:
    axes = [F.col("coords")[i].alias(f"x{i}") for i in range(3)]
    return centers.select(*keys, "rank", "id", *axes, "label")


# points and clustering


def point_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "points")
    points = tb.order_points(spark, sf)
    fields = [F.col("coords")[i].cast("string") for i in range(3)]
    dealt = points.repartitionByRange("id").sortWithinPartitions("id")
    dealt.select(F.concat_ws(",", *fields, "label").alias("value")).write.text(path)
    axes = [F.col("coords")[i].alias(f"x{i}") for i in range(3)]
    return read_points(spark, path).select("id", *axes, "label")


def point_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Fields with blanks around them, five coordinates, ids kept."""
    orders = tb.table(spark, sf, "orders")
    line = F.format_string(
        " %s,%s,%s,%s,%s, %s\t", F.col("o_custkey"), F.col("o_orderkey"), F.month("o_orderdate"),
        F.year("o_orderdate"), F.floor("o_totalprice"), "o_orderstatus",
    )
    parsed = parse_points(orders.select(F.col("o_orderkey").alias("id"), line.alias("value")))
    return parsed.select("id", *[F.col("coords")[i].alias(f"x{i}") for i in range(5)], "label")


def part_sizes(spark: SparkSession, sf: str) -> DataFrame:
    points = with_part(tb.order_points(spark, sf), PARTS)
    return points.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def embedding_centers(spark: SparkSession, sf: str) -> DataFrame:
    return fair_fft(tb.embedding_points(spark, sf), 5, 4).select("rank", "id", "label")


def embedding_radius(spark: SparkSession, sf: str) -> DataFrame:
    points = tb.embedding_points(spark, sf)
    far = objective(points, fair_fft(points, 5, 4))
    return far.select(F.round("objective", 6).alias("objective"))


def coreset(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(local_centers(with_part(tb.order_points(spark, sf), PARTS), KA, KB, PARTS), "part")


def coreset_in_step(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the path for parts that no task could hold."""
    points = with_part(tb.order_points(spark, sf), PARTS)
    return _flat(local_centers(points, KA, KB, PARTS, group_bytes=0), "part")


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    points = tb.order_points(spark, sf)
    near = nearest_center(points, fair_fft(points, KA, KB))
    return near.select("id", "label", F.round("distance", 6).alias("distance"))


def radius(spark: SparkSession, sf: str) -> DataFrame:
    points = tb.order_points(spark, sf)
    far = objective(points, mr_fair_fft(points, KA, KB, PARTS))
    return far.select(F.round("objective", 6).alias("objective"))


def report(spark: SparkSession, sf: str) -> DataFrame:
    made = ex.clustering_report(tb.order_points(spark, sf), KA, KB, PARTS)
    return made.select("n", "na", "nb", F.round("objective", 6).alias("objective"))


def distances(spark: SparkSession, sf: str) -> DataFrame:
    """Squared distance of every order to its customer's point."""
    customers = tb.table(spark, sf, "customer").select(
        F.col("c_custkey"),
        F.array(F.col("c_custkey").cast("double"), F.floor("c_acctbal").cast("double"), F.lit(6.0)).alias("at"),
    )
    points = tb.order_points(spark, sf).withColumn("c_custkey", F.col("coords")[0].cast("bigint"))
    return points.join(customers, "c_custkey").select("id", squared_distance("coords", "at").alias("squared"))


# documents


def docs_file(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text, read back one per line and counted."""
    path = scratch_path(spark, "docs")
    tb.table(spark, sf, "documents").select("text").write.text(path)
    return words.word_report(read_docs(spark, path, PARTS)).withColumn(
        "mean_length", F.round("mean_length", 6)
    )


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words and empty words per document line."""
    spread = tokens(tb.document_lines(spark, sf))
    return spread.groupBy(*LINE_KEYS).agg(
        F.count(F.lit(1)).alias("words"),
        F.count_if(F.col("word") == "").alias("empty_words"),
        F.sum(F.length("word")).alias("letters"),
    )


def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document line; lines share their keys only if documents share their id."""
    again = words.repeated(tb.table(spark, sf, "documents"))
    return words.doc_word_count(tb.document_lines(spark, sf), LINE_KEYS, again)


def mean_length(spark: SparkSession, sf: str) -> DataFrame:
    made = words.mean_word_length(tb.document_lines(spark, sf))
    return made.select(F.round("mean_length", 6).alias("mean_length"))


# stream items


def _items(spark: SparkSession, sf: str) -> tuple[DataFrame, fq.Frequency]:
    items = tb.event_items(spark, sf)
    return items, frequency_run(items.count())


def item_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text lines, parsed as items and counted."""
    lines = tb.event_items(spark, sf).select(F.format_string(" %s ", "item").alias("value"))
    return fq.histogram(parse_items(lines))


def prefix(spark: SparkSession, sf: str) -> DataFrame:
    items = tb.event_items(spark, sf)
    return fq.stream_prefix(items, prefix_length(items.count()))


def prefix_end(spark: SparkSession, sf: str) -> DataFrame:
    """Where the prefix ends by item value, found without sorting."""
    items = tb.event_items(spark, sf)
    rows = items.count()
    cut_at = {name: kth_smallest(items, name, prefix_length(rows)) for name in ("seq", "item")}
    top = items.agg(F.min("seq").alias("first_seq"))
    return top.select("first_seq", *[F.lit(v).cast("bigint").alias(f"{k}_cut") for k, v in cut_at.items()])


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    """Coin and first two hash values of every event."""
    (a, b), (c, d) = hash_pairs(2, SEED)
    return tb.event_items(spark, sf).select(
        "seq",
        "item",
        coin(SEED, "seq").alias("u"),
        universal_hash("item", a, b, WIDTH).alias("h0"),
        universal_hash("item", c, d, WIDTH).alias("h1"),
    )


def classes(spark: SparkSession, sf: str) -> DataFrame:
    items, run = _items(spark, sf)
    kind = classify("n", run.n, run.phi, CLASS_EPSILON)
    return fq.histogram(items).select("item", "n", kind.alias("kind"))


def on_items(operator: Callable[[DataFrame, fq.Frequency], DataFrame]) -> Query:
    return lambda spark, sf: operator(*_items(spark, sf))


def frequent_report(spark: SparkSession, sf: str) -> DataFrame:
    """The three answers side by side, each item with its true frequency."""
    items, run = _items(spark, sf)
    return _side_by_side(
        fq.true_frequent(items, run), fq.sticky_frequent(items, run), fq.countmin_frequent(items, run), fq.histogram(items)
    )


def _side_by_side(exact: DataFrame, sticky: DataFrame, countmin: DataFrame, truth: DataFrame) -> DataFrame:
    """Exact and count-min answers hold their true count already; only sticky ones are looked up."""
    counted = sticky.select("item").join(truth, "item")
    parts = {"exact": exact, "sticky": counted, "countmin": countmin}
    named = [p.select(F.lit(k).alias("algorithm"), "item", F.col("n").alias("true_freq")) for k, p in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).orderBy("algorithm", "item")


def quality(spark: SparkSession, sf: str) -> DataFrame:
    items = tb.event_items(spark, sf)
    return ex.quality_runs(items, items.count(), PHI, EPSILONS, WIDTHS, CLASS_EPSILON, SEEDS)


def quality_means(spark: SparkSession, sf: str) -> DataFrame:
    means = fq.quality_averages(quality(spark, sf))
    return means.select(
        "algorithm", "param", *[F.round(c, 6).alias(c) for c in ("frequent", "almost", "rare", "size")]
    )


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """The averages as written to the summary sink and read back."""
    path = scratch_path(spark, "summary")
    write_summary(fq.quality_averages(quality(spark, sf)), path)
    schema = "param double, frequent string, almost string, rare string, size string, algorithm string"
    return spark.read.schema(schema).csv(path, header=True)


# distinct items by batch


def taken(spark: SparkSession, sf: str) -> DataFrame:
    batches = tb.event_batches(spark, sf)
    return ds.whole_batches(batches, prefix_length(batches.count()))


def on_batches(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(tb.event_batches(spark, sf))


# streams


def _arrivals(spark: SparkSession, sf: str, start: Callable) -> None:
    """Events arriving in order as appended files, each append followed by a stream run.

    The stream goes on from its checkpoint, so an append is one micro-batch, whatever its
    number of files.
    """
    items = tb.event_items(spark, sf)
    rows, inbox = items.count(), scratch_path(spark, "inbox")
    for cut in range(STREAM_CUTS):
        low, high = rows * cut // STREAM_CUTS, rows * (cut + 1) // STREAM_CUTS
        items.filter((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(inbox)
        start(read_item_stream(spark, inbox), rows).awaitTermination()


def _frequency_stream(spark: SparkSession, sf: str) -> tuple[str, fq.Frequency]:
    root, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    run = frequency_run(prefix_length(tb.event_items(spark, sf).count()))
    _arrivals(spark, sf, lambda items, rows: jobs.start_frequency(items, root, checkpoint, run))
    return root, run


def stream_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_answers(spark, *_frequency_stream(spark, sf))


def _stream_answers(spark: SparkSession, root: str, run: fq.Frequency) -> DataFrame:
    return _side_by_side(
        jobs.stream_true_frequent(spark, root, run), jobs.stream_sticky_frequent(spark, root, run),
        jobs.stream_countmin_frequent(spark, root, run), jobs.stream_histogram(spark, root),
    )


def stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The same after the first and the last batch have been run a second time."""
    root, run = _frequency_stream(spark, sf)
    items = tb.event_items(spark, sf)
    rows, state = items.count(), BatchState(spark, root, jobs.FREQUENCY, jobs.FREQUENCY_FOLDS)
    for cut in (0, STREAM_CUTS - 1):
        low, high = rows * cut // STREAM_CUTS, rows * (cut + 1) // STREAM_CUTS
        jobs.update_frequency(state, items.filter((F.col("seq") >= low) & (F.col("seq") < high)), cut, run)
    return _stream_answers(spark, root, run)


def stream_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The same after all batches but the last were folded, with a folded and the last one run again."""
    root, run = _frequency_stream(spark, sf)
    items = tb.event_items(spark, sf)
    rows, state = items.count(), BatchState(spark, root, jobs.FREQUENCY, jobs.FREQUENCY_FOLDS)
    state.compact(STREAM_CUTS - 2)
    for cut in (0, STREAM_CUTS - 1):
        low, high = rows * cut // STREAM_CUTS, rows * (cut + 1) // STREAM_CUTS
        jobs.update_frequency(state, items.filter((F.col("seq") >= low) & (F.col("seq") < high)), cut, run)
    return _stream_answers(spark, root, run)


def stream_text_frequent(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text files that all come in one batch; the prefix ends inside a file."""
    items = tb.event_items(spark, sf)
    rows, inbox = items.count(), scratch_path(spark, "inbox")
    tb.write_in_order(items.select("seq", F.col("item").cast("string").alias("value")), "seq", inbox, rows // 3 + 1)
    root, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    run = frequency_run(prefix_length(rows))
    jobs.start_frequency(read_item_stream(spark, inbox, "text"), root, checkpoint, run).awaitTermination()
    return _stream_answers(spark, root, run)


def _native_stream(spark: SparkSession, sf: str, operator: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """A native streaming operator over the events, its last output written to the shared folder."""
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "native")
    tb.event_items(spark, sf).write.parquet(inbox)
    made = operator(read_item_stream(spark, inbox))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    writer = made.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", scratch_path(spark, "offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream_sample(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _frequency_stream(spark, sf)
    return jobs.stream_sticky_sample(spark, root)


def stream_keyed_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sticky sample from keyed state; what each batch gave out is kept, the last count of an item holds."""
    out, checkpoint = scratch_path(spark, "keyed"), scratch_path(spark, "offsets")
    run = frequency_run(prefix_length(tb.event_items(spark, sf).count()))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def start(items: DataFrame, rows: int):
        writer = streaming_sticky_sample(items, run).writeStream.foreachBatch(keep).outputMode("update")
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    with keyed_state(spark):
        _arrivals(spark, sf, start)
    return spark.read.schema("item bigint, n bigint").parquet(out).groupBy("item").agg(F.max("n").alias("n"))


def stream_sizes(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _frequency_stream(spark, sf)
    return jobs.stream_batch_sizes(spark, root)


def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    root, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    _arrivals(
        spark,
        sf,
        lambda items, rows: jobs.start_distinct(items, root, checkpoint, rows * 3 // 5),
    )
    return jobs.stream_distinct_report(spark, root)


# logs


def on_records(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(runs.run_records(tb.order_logs(spark, sf)))


def run_logs_file(spark: SparkSession, sf: str) -> DataFrame:
    """The same logs written as files of their names, and those of known name read by glob."""
    folder = scratch_path(spark, "logs")
    tb.write_logs(tb.order_logs(spark, sf), folder)
    return runs.run_records(read_run_logs(spark, f"{folder}/file=combined_logs_*"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def all_queries() -> dict[str, Query]:
    points, lines, log = tb.order_points, tb.document_lines, tb.order_logs
    return {
        "point_scan": point_scan,
        "point_parse": point_parse,
        "label_counts": lambda s, d: label_counts(points(s, d)),
        "part_sizes": part_sizes,
        "squared_distance": distances,
        "fair_fft": lambda s, d: _flat(fair_fft(points(s, d), KA, KB)),
        "fair_fft_seeded": lambda s, d: _flat(fair_fft(points(s, d), KA, KB, first=SEED)),
        "fair_fft_lazy": lambda s, d: _flat(fair_fft_lazy(points(s, d), KA, KB)),
        "mr_fair_fft_placed": lambda s, d: _flat(mr_fair_fft(dealt(points(s, d), PARTS), KA, KB, PARTS)),
        "fair_fft_one_budget": lambda s, d: _flat(fair_fft(points(s, d), 0, 5)),
        "fair_fft_embeddings": embedding_centers,
        "fair_fft_embeddings_radius": embedding_radius,
        "local_centers": coreset,
        "local_centers_in_step": coreset_in_step,
        "mr_fair_fft": lambda s, d: _flat(mr_fair_fft(points(s, d), KA, KB, PARTS)),
        "mr_fair_fft_seeded": lambda s, d: _flat(mr_fair_fft(points(s, d), 8, 2, 16, first=SEED)),
        "nearest_center": nearest,
        "objective": radius,
        "clustering_report": report,
        "doc_count": lambda s, d: words.doc_count(lines(s, d)),
        "docs_file": docs_file,
        "tokens": token_counts,
        "doc_word_count": doc_words,
        "word_count": lambda s, d: words.word_count(lines(s, d)),
        "word_count_salted_shuffle": lambda s, d: words.word_count_salted_shuffle(lines(s, d), PARTS, LINE_KEYS),
        "word_count_salted_map": lambda s, d: words.word_count_salted_map(lines(s, d), PARTS, LINE_KEYS),
        "word_count_partitioned": lambda s, d: words.word_count_partitioned(lines(s, d)),
        "distinct_words": lambda s, d: words.distinct_words(lines(s, d)),
        "mean_word_length": mean_length,
        "item_parse": item_parse,
        "stream_prefix": prefix,
        "stream_prefix_end": prefix_end,
        "hash_values": hashed,
        "histogram": lambda s, d: fq.histogram(tb.event_items(s, d)),
        "quality_class": classes,
        "true_frequent": on_items(fq.true_frequent),
        "sticky_sample": on_items(fq.sticky_sample),
        "sticky_frequent": on_items(fq.sticky_frequent),
        "sticky_sample_size": on_items(fq.sample_size),
        "countmin_matrix": on_items(fq.countmin_matrix),
        "countmin_crossings": on_items(lambda i, r: fq.cell_crossings(i, [r]).drop("run")),
        "countmin_frequent": on_items(fq.countmin_frequent),
        "countmin_total": on_items(lambda i, r: fq.returned_total(fq.countmin_frequent(i, r))),
        "frequent_report": frequent_report,
        "quality_counts": quality,
        "quality_averages": quality_means,
        "summary": summary,
        "whole_batches": taken,
        "batch_sizes": on_batches(ds.batch_sizes),
        "distinct_by_batch": on_batches(ds.distinct_by_batch),
        "distinct_items": on_batches(ds.distinct_items),
        "distinct_report": on_batches(ds.distinct_report),
        "stream_frequent": stream_frequent,
        "stream_replay": stream_replay,
        "stream_compacted": stream_compacted,
        "stream_text_frequent": stream_text_frequent,
        "stream_native_histogram": lambda s, d: _native_stream(s, d, jobs.streaming_histogram, "complete"),
        "stream_native_distinct": lambda s, d: _native_stream(s, d, jobs.streaming_distinct, "append"),
        "stream_sticky_sample": stream_sample,
        "stream_keyed_sample": stream_keyed_sample,
        "stream_batch_sizes": stream_sizes,
        "stream_distinct": stream_distinct,
        "run_logs_file": run_logs_file,
        "run_records": on_records(lambda r: r),
        "objective_statistics": on_records(
            lambda r: _rounded(runs.objective_statistics(r), "mean_objective", "std_objective")
        ),
        "runtime_mean": on_records(lambda r: _rounded(runs.runtime_statistics(r), "runtime_ms")),
        "runtime_min": on_records(lambda r: runs.runtime_statistics(r, "min")),
    }

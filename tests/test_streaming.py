import os
import time

import pytest
from pyspark.errors import StreamingQueryException

from fairstream.operators import frequency as fq
from fairstream.sources.streams import read_item_stream
from fairstream.streaming import jobs
from fairstream.streaming.state import BatchState
from tests.test_frequency import pairs, simulate, skewed

RUN = fq.Frequency(700, 0.02, 0.01, seed=3, width=25)


def ordered_files(folder, cuts, items, fmt="parquet"):
    """One file per cut, with rising modification times."""
    import pandas as pd

    folder.mkdir()
    start = 0
    for number, size in enumerate(cuts):
        part = list(enumerate(items))[start : start + size]
        start += size
        path = folder / f"{len(cuts) - number:03d}.{fmt}"  # names fall as times rise
        if fmt == "text":
            path.write_text("".join(f" {x} \n" for _, x in part))
        else:
            frame = pd.DataFrame(part[::-1], columns=["seq", "item"], dtype="int64")
            frame.to_parquet(path)
        stamp = time.time() - 1000 + number
        os.utime(path, (stamp, stamp))
    return str(folder)


def run_frequency(spark, tmp_path, source, fmt="parquet", run=RUN, name="a"):
    root = str(tmp_path / f"state-{name}")
    stream = read_item_stream(spark, source, fmt, files_per_batch=1)
    jobs.start_frequency(stream, root, str(tmp_path / f"check-{name}"), run).awaitTermination()
    return root


def check(spark, root, items, run=RUN, key=lambda i: i):
    exact, sticky, found, _ = simulate(items[: run.n], run, key)
    assert pairs(jobs.stream_histogram(spark, root)) == exact
    assert pairs(jobs.stream_sticky_sample(spark, root)) == sticky
    high = {x: n for x, n in sticky.items() if n >= run.sticky_threshold}
    assert pairs(jobs.stream_sticky_frequent(spark, root, run)) == high
    assert pairs(jobs.stream_true_frequent(spark, root, run)) == {
        x: n for x, n in exact.items() if n >= run.threshold
    }
    assert pairs(jobs.stream_countmin_frequent(spark, root, run)) == {x: exact[x] for x in found}


@pytest.mark.parametrize("cuts,sizes", [
    ([300, 0, 250, 300, 50], [300, 250, 150]),
    ([700, 100], [700]),
    ([1, 899], [1, 699]),
])
def test_any_split_gives_the_batch_answer(spark, tmp_path, cuts, sizes):
    items = skewed(900, seed=3)
    root = run_frequency(spark, tmp_path, ordered_files(tmp_path / "in", cuts, items))
    check(spark, root, items)
    found = jobs.stream_batch_sizes(spark, root).orderBy("batch_id").collect()
    assert [r["size"] for r in found] == sizes


def test_stream_shorter_than_n(spark, tmp_path):
    items = skewed(400, seed=5)
    root = run_frequency(spark, tmp_path, ordered_files(tmp_path / "in", [150, 250], items))
    check(spark, root, items)


def test_text_without_seq_uses_line_order(spark, tmp_path):
    items, cuts = skewed(900, seed=6), [300, 250, 350]
    root = run_frequency(spark, tmp_path, ordered_files(tmp_path / "in", cuts, items, "text"), "text")
    place = [(b, i) for b, size in enumerate(cuts) for i in range(size)]
    check(spark, root, items, key=lambda i: f"{place[i][0]}:{place[i][1]}")


def test_replaying_any_batch_changes_nothing(spark, tmp_path):
    items, cuts = skewed(900, seed=7), [200, 200, 200, 300]
    root = run_frequency(spark, tmp_path, ordered_files(tmp_path / "in", cuts, items))
    state = BatchState(spark, root, jobs.FREQUENCY)
    for batch_id in (3, 0, 1, 1):
        low = sum(cuts[:batch_id])
        rows = list(enumerate(items))[low : low + cuts[batch_id]]
        batch = spark.createDataFrame(rows, "seq bigint, item bigint")
        jobs.update_frequency(state, batch, batch_id, RUN)
    check(spark, root, items)
    assert state.sizes().agg({"size": "sum"}).head()[0] == RUN.n


def test_an_uncommitted_batch_has_not_happened(spark, tmp_path):
    items = skewed(900, seed=8)
    root = run_frequency(spark, tmp_path, ordered_files(tmp_path / "in", [200, 200], items))
    state = BatchState(spark, root, jobs.FREQUENCY)
    torn = spark.createDataFrame([(5, 999, 1, 999)], jobs.FREQUENCY["items"])
    state.write("items", 2, torn)
    check(spark, root, items[:400])
    assert state.last_before(3) == (1, 400)


def test_a_bad_item_stops_the_stream_and_leaves_whole_batches(spark, tmp_path):
    source = ordered_files(tmp_path / "in", [3, 2], [1, 2, 2, 7, 7], "text")
    (tmp_path / "in" / "001.text").write_text("7\nx\n")
    stamp = time.time() - 10
    os.utime(tmp_path / "in" / "001.text", (stamp, stamp))
    with pytest.raises(StreamingQueryException):
        run_frequency(spark, tmp_path, source, "text")
    assert pairs(jobs.stream_histogram(spark, str(tmp_path / "state-a"))) == {1: 1, 2: 2}


@pytest.mark.parametrize("threshold,taken", [(0, 0), (10, 10), (11, 30), (30, 30), (500, 60)])
def test_distinct_items_of_whole_batches(spark, tmp_path, threshold, taken):
    items = skewed(60, seed=9)
    source = ordered_files(tmp_path / "in", [10, 20, 30], items, "text")
    root, checkpoint = str(tmp_path / "state"), str(tmp_path / "check")
    stream = read_item_stream(spark, source, "text", files_per_batch=1)
    jobs.start_distinct(stream, root, checkpoint, threshold).awaitTermination()
    kept = items[:taken]
    row = jobs.stream_distinct_report(spark, root).head()
    assert tuple(row) == (taken, len(set(kept)), max(kept, default=None))
    assert {r.item for r in jobs.stream_distinct_items(spark, root).collect()} == set(kept)


def test_native_operators(spark, tmp_path):
    items = skewed(300, seed=10)
    source = ordered_files(tmp_path / "in", [100, 100, 100], items)
    for name, made, mode in (
        ("histogram", jobs.streaming_histogram, "complete"),
        ("distinct", jobs.streaming_distinct, "append"),
    ):
        stream = made(read_item_stream(spark, source, files_per_batch=1))
        writer = stream.writeStream.format("memory").queryName(f"native_{name}").outputMode(mode)
        query = writer.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    exact = simulate(items, RUN)[0]
    assert pairs(spark.table("native_histogram")) == exact
    assert sorted(r.item for r in spark.table("native_distinct").collect()) == sorted(exact)


@pytest.mark.parametrize("bytes_", ["128m", "40b"])
def test_text_files_of_one_batch_come_in_order(spark, tmp_path, bytes_):
    """Whatever their sizes and splits: a large file in the middle, n inside it."""
    items = skewed(900, seed=12)
    source = ordered_files(tmp_path / "in", [3, 850, 47], items, "text")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_ if bytes_ != "40b" else "700b")
    try:
        root = str(tmp_path / "state")
        stream = read_item_stream(spark, source, "text")
        jobs.start_frequency(stream, root, str(tmp_path / "check"), RUN).awaitTermination()
        check(spark, root, items, key=lambda i: f"0:{i}")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_batch_finds_the_one_before_by_its_path(spark, tmp_path):
    state = BatchState(spark, str(tmp_path / "state"), jobs.FREQUENCY)
    for batch_id in range(12):
        state.commit(batch_id, 5, 5 * (batch_id + 1))
    assert len(state.read_batch("sizes", 9).inputFiles()) == 1
    assert state.last_before(10) == (9, 50) and state.last_before(20) == (11, 60) and state.last_before(0) == (-1, 0)


def test_compaction_keeps_answers_and_bounds_files(spark, tmp_path, monkeypatch):
    """Twelve batches, folded every third: the same answers from as many files; a torn fold and replays do no harm."""
    from fairstream.streaming import state as states

    monkeypatch.setattr(states, "COMPACT_EVERY", 3)
    items = skewed(900)
    source = ordered_files(tmp_path / "in", [75] * 12, items)
    root = run_frequency(spark, tmp_path, source)
    check(spark, root, items)
    state = jobs._frequency_state(spark, root)
    assert state.upto >= 6 and state.version >= 1
    batches = [d for d in os.listdir(f"{root}/items") if d.startswith("batch_id=") and d != "batch_id=-1"]
    assert len(batches) <= 4 and len(os.listdir(f"{root}/snapshots")) == 1
    sizes = [r.size for r in jobs.stream_batch_sizes(spark, root).orderBy("batch_id").collect()]
    assert sizes == [75] * 9 + [25]
    # a folded batch run again with other items, and a snapshot whose manifest was never written
    other = spark.createDataFrame([(0, 999)], "seq bigint, item bigint")
    jobs.update_frequency(state, other, 2, RUN)
    spark.range(3).write.parquet(f"{root}/snapshots/99-torn/items")
    check(spark, root, items)


def test_scratch_is_cleared(spark):
    from fairstream.plans import storage

    since = len(storage._given_out)
    kept = storage.stored(spark.range(5), "gone")
    path = storage._given_out[-1].removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(path)
    assert storage.clear_scratch(spark, since) == 1 and not os.path.isdir(path)


def test_an_endless_source_ends_with_its_fill(spark, tmp_path):
    """The query ends by itself, no batch after the last one taken leaves anything, a new start ends at once."""
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 150).load()
    items = rate.selectExpr("value AS seq", "value % 37 AS item")
    root, checkpoint = str(tmp_path / "state"), str(tmp_path / "check")
    for _ in range(2):
        query = jobs.start_frequency(items, root, checkpoint, RUN, {"processingTime": "0 seconds"})
        assert query.awaitTermination(120) and query.exception() is None
        check(spark, root, [i % 37 for i in range(2000)])
        assert [r.size for r in jobs.stream_batch_sizes(spark, root).orderBy("batch_id").collect()] == [150] * 4 + [100]


def test_arrivals_since_the_first_win_in_any_order():
    import random

    import pandas as pd

    from fairstream.streaming.keyed import arrivals_since_win

    rng = random.Random(5)
    for _ in range(200):
        rows = [(i, rng.random() < 0.1) for i in range(rng.randrange(60))]
        wins = [i for i, won in rows if won]
        rng.shuffle(rows)
        frames = [pd.DataFrame(rows[i : i + 7], columns=["seq", "won"]) for i in range(0, len(rows), 7)]
        assert arrivals_since_win(iter(frames)) == (len(rows) - min(wins) if wins else 0)


@pytest.mark.parametrize("cuts", [[900], [1, 300, 0, 599]])
def test_keyed_state_gives_the_sticky_sample(spark, tmp_path, cuts):
    """Whatever the batches, and after a restart in between."""
    from fairstream.streaming.keyed import keyed_state, streaming_sticky_sample

    items = skewed(900)
    source, out, checkpoint = ordered_files(tmp_path / "in", cuts, items), str(tmp_path / "out"), str(tmp_path / "check")
    for files in (1, 10):  # the second start finds nothing new
        stream = streaming_sticky_sample(read_item_stream(spark, source, "parquet", files_per_batch=files), RUN)
        with keyed_state(spark):
            writer = stream.writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch_id={k}"))
            writer.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    found = {}
    for r in rows:
        found[r.item] = max(r.n, found.get(r.item, 0))
    assert found == simulate(items[: RUN.n], RUN, lambda i: i)[1]

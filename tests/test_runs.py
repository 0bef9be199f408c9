import statistics

import pytest

from fairstream.operators import runs
from fairstream.sources.files import read_run_logs, write_summary


def section(dataset, obj, ms, ka=8, kb=2, extra=()):
    return [
        f"File path = {dataset}, KA = {ka}, KB = {kb}, L = 16",
        "N = 10, NA = 7, NB = 3",
        "Center = [1.0,2.0] Label = A",
        *extra,
        f"Objective function = {obj}",
        f"Running time of MRFairFFT = {ms} ms",
    ]


LOG = [
    *section("ArtificialLost.csv", 1.0, 1),  # no header yet: not a record
    "=== FILE: ArtificialN1_2.log ===",
    *section("ArtificialN1.csv", 10.5, 100),
    "=== FILE: ArtificialN1_4.log ===",
    *section("ArtificialN1.csv", 11.5, 60),
    *section("ArtificialN1.csv", 12.0, 80, extra=["noise", ""]),
    "===  FILE: x_y_16.log===",
    "Traceback (most recent call last):",
    "=== FILE: ArtificialN1_8.log ===",
    "File path = ArtificialGone.csv, KA = 1, KB = 1, L = 2",
    *section("other.txt", 3, 40, ka=1, kb=0),
    "Running time of MRFairFFT = 7 ms",  # nothing since the last record
]
RECORDS = [
    ("N1", 2, 16, 100, "8", "2", 10.5),
    ("N1", 4, 16, 60, "8", "2", 11.5),
    ("N1", 4, 16, 80, "8", "2", 12.0),
    ("other.txt", 8, 16, 40, "1", "0", 3.0),
]


def lines(spark, files, chunk):
    rows = [(f, i // chunk, i, v) for f, text in files.items() for i, v in enumerate(text)]
    return spark.createDataFrame(rows[::-1], "file string, chunk bigint, line bigint, value string")


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_records_whatever_the_chunks(spark, chunk):
    files = {"combined_logs_v1.txt": LOG, "/d/combined_logs_low_mem.txt": LOG, "odd.txt": LOG}
    found = sorted(tuple(r) for r in runs.run_records(lines(spark, files, chunk)).collect())
    assert found == sorted((v, *r) for v in ("v1", "low_mem", "unknown") for r in RECORDS)


def test_logs_from_files(spark, tmp_path):
    (tmp_path / "combined_logs_v1.txt").write_text("\n".join(LOG) + "\n")
    (tmp_path / "combined_logs_v2.txt").write_text("\n".join(LOG[:11]) + "\n")
    (tmp_path / "notes.txt").write_text("\n".join(LOG))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        found = runs.run_records(read_run_logs(spark, f"{tmp_path}/combined_logs_*.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in found if r.version == "v1") == sorted(("v1", *r) for r in RECORDS)
    assert {r.version for r in found} == {"v1", "v2"}


def test_no_log_files(spark, tmp_path):
    assert runs.run_records(read_run_logs(spark, f"{tmp_path}/combined_logs_*.txt")).count() == 0


def test_statistics(spark):
    records = runs.run_records(lines(spark, {"combined_logs_v1.txt": LOG}, 4))
    by = {r.dataset: r for r in runs.objective_statistics(records).collect()}
    assert by["N1"].mean_objective == pytest.approx(34 / 3)
    assert by["N1"].std_objective == pytest.approx(statistics.stdev([10.5, 11.5, 12.0]))
    assert by["other.txt"].std_objective == 0.0
    for how, expected in (("avg", 70.0), ("min", 60.0)):
        times = {(r.dataset, r.workers): r.runtime_ms for r in runs.runtime_statistics(records, how).collect()}
        assert times == {("N1", 2): 100.0, ("N1", 4): expected, ("other.txt", 8): 40.0}
    with pytest.raises(ValueError):
        runs.runtime_statistics(records, "max")


def test_summary_sink(spark, tmp_path):
    rows = [("sticky", 0.01, 10.0, 11 / 3, 0.0, 35.0), ("countmin", 15.0, 10.0, 0.0, 1234.5, 1244.5)]
    df = spark.createDataFrame(
        rows, "algorithm string, param double, frequent double, almost double, rare double, size double"
    )
    write_summary(df, str(tmp_path / "s"))
    text = [p.read_text() for p in sorted((tmp_path / "s").glob("*/*.csv"))]
    assert text == [
        "param,frequent,almost,rare,size\n15.0,10.00,0.00,1234.50,1244.50\n",
        "param,frequent,almost,rare,size\n0.01,10.00,3.67,0.00,35.00\n",
    ]


def test_version_by_file_name_and_no_empty_data_set(spark):
    log = ["=== FILE: a_2.log ===", *section("Artificial.csv", 1.0, 5), *section("ArtificialX.csv", 2.0, 6)]
    files = {"/x/combined_logs_old/combined_logs_v1.txt": log}
    found = [(r.version, r.dataset, r.runtime_ms) for r in runs.run_records(lines(spark, files, 3)).collect()]
    assert found == [("v1", "X", 6)]


def read_in_order(text):
    """A reader of one log, line by line: what it has in hand goes with each record."""
    import re

    workers = config = objective = None
    for line in text:
        if m := re.search(runs.HEADER, line):
            workers = int(m[1])
        elif m := re.search(runs.CONFIG, line):
            named = re.search(runs.DATASET, m[1])
            config = (named[1] if named else m[1], int(m[4]), m[2], m[3])
        elif m := re.search(runs.OBJECTIVE, line):
            objective = float(m[1])
        elif (m := re.search(runs.RUNTIME, line)) and config and config[0] and workers is not None and objective is not None:
            yield config[0], workers, config[1], int(m[1]), config[2], config[3], objective
            config = objective = None


@pytest.mark.parametrize("seed", range(4))
def test_malformed_logs_against_a_line_by_line_reader(spark, seed):
    """Lines of all kinds in any order: values outlive runtime lines that are no records."""
    import random

    rng = random.Random(seed)
    kinds = [
        lambda: f"=== FILE: a_{rng.randint(1, 16)}.log ===",
        lambda: f"File path = Artificial{rng.choice(['', 'N1', 'N2'])}.csv, KA = {rng.randint(1, 9)}, KB = 2, L = 16",
        lambda: f"Objective function = {rng.randint(1, 99)}.5",
        lambda: f"Running time of MRFairFFT = {rng.randint(1, 999)} ms",
        lambda: "Center = [1.0] Label = A",
    ]
    files = {f"combined_logs_v{i}.txt": [rng.choice(kinds)() for _ in range(rng.choice([0, 3, 60, 400]))] for i in range(6)}
    expected = sorted((f"v{i}", *r) for i, text in enumerate(files.values()) for r in read_in_order(text))
    for chunk in (1, 7, 1000):
        found = sorted(tuple(r) for r in runs.run_records(lines(spark, files, chunk)).collect())
        assert found == expected


def test_a_log_in_several_files(spark, tmp_path):
    """A folder of files is one log, read in order of the paths and splits."""
    from fairstream.plans.tables import write_logs

    text = LOG * 40
    rows = [("combined_logs_v1.txt", 0, i, v) for i, v in enumerate(text)] + [("other.txt", 0, i, v) for i, v in enumerate(LOG)]
    made = spark.createDataFrame(rows, "file string, chunk bigint, line bigint, value string")
    write_logs(made, str(tmp_path / "logs"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        found = runs.run_records(read_run_logs(spark, f"{tmp_path}/logs/file=combined_logs_*")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in found) == sorted(("v1", *r) for r in read_in_order(text))

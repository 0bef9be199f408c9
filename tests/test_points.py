import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fairstream.functions.parsing import parse_items, parse_points
from fairstream.operators.points import label_counts, with_part
from fairstream.sources.files import read_points


def test_points_are_stripped_and_typed(lines):
    rows = parse_points(lines(" 1, 2.5 ,-3e2, A \r", "0,0,0,C")).orderBy("id").collect()
    assert [(r.coords, r.label) for r in rows] == [([1.0, 2.5, -300.0], "A"), ([0.0, 0.0, 0.0], "C")]


@pytest.mark.parametrize("bad", ["1,x,A", "1,,A", "", "   ", "A", "1.0d,2,A", "1,2f,A", "1,2D ,A"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_points_fail_the_job(spark, lines, bad, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException):
            parse_points(lines("1,2,A", bad)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_blank_lines_can_be_dropped(lines):
    assert parse_points(lines("1,2,A", "", " \t"), drop_blank=True).count() == 1


@pytest.mark.parametrize("bad", ["1.5", "x", ""])
def test_bad_items_fail_the_job(lines, bad):
    with pytest.raises(PySparkException):
        parse_items(lines("1", bad)).collect()


def test_items_may_be_negative(lines):
    assert [r.item for r in parse_items(lines(" 7 ", "-3")).orderBy("id").collect()] == [7, -3]


def test_points_from_a_file_with_crlf(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes(b"1.0,2.0,A\r\n3.0,4.0,B b\r\n")
    rows = read_points(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(0, [1.0, 2.0], "A"), (1, [3.0, 4.0], "B b")]


def test_every_other_label_counts_as_the_second_group(lines):
    points = parse_points(lines("1,A", "2,B", "3,C", "4,a"))
    assert tuple(label_counts(points).head()) == (4, 1, 3)


def test_parts_cover_all_points_evenly(spark):
    parts = with_part(spark.range(-5, 95).select(F.col("id")), 7).groupBy("part").count().collect()
    assert {r.part for r in parts} == set(range(7)) and max(r["count"] for r in parts) <= 15


def test_all_blanks_are_stripped_and_infinite_numbers_stay(lines):
    rows = parse_points(lines("1,2,A\u00a0", "\u2003inf,3e1,1.5d\x85")).orderBy("id").collect()
    assert [(r.coords, r.label) for r in rows] == [([1.0, 2.0], "A"), ([float("inf"), 30.0], "1.5d")]


def test_ids_are_line_numbers_whatever_the_splits(spark, tmp_path):
    """Two files and blank lines; small and large input splits give the same ids."""
    for name, first in (("a.csv", 0), ("b.csv", 400)):
        lines = [f"{i},{i % 7},{'AB'[i % 2]}" if i % 50 else "" for i in range(first, first + 400)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    found = []
    for size in ("200b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found.append(sorted((r.id, r.coords[0]) for r in read_points(spark, str(tmp_path), drop_blank=True).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == [(i, float(i)) for i in range(800) if i % 50]

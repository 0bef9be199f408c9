"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``mr_rounds_*`` time the two clustering rounds alone over persisted points, as the published
figures do; every other entry includes reading its tables. ``mr_rounds_130k``, ``_1300k`` and
``_13000k`` have the published shape: so many points of seven coordinates, made from a seed, 3 of
13 outside the first group, 8 + 2 centers, 16 parts, dealt out and held before the time starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fairstream.operators.kcenter import dealt, mr_fair_fft  # noqa: E402
from fairstream.plans import tables  # noqa: E402
from fairstream.plans.queries import all_queries  # noqa: E402
from fairstream.plans.session import local_session  # noqa: E402
from fairstream.plans.storage import persisted  # noqa: E402

HEADLINE = (
    "mr_fair_fft",
    "fair_fft",
    "fair_fft_lazy",
    "objective",
    "nearest_center",
    "fair_fft_embeddings",
    "doc_word_count",
    "word_count",
    "word_count_salted_shuffle",
    "word_count_salted_map",
    "word_count_partitioned",
    "mean_word_length",
    "histogram",
    "sticky_frequent",
    "countmin_frequent",
    "frequent_report",
    "quality_averages",
    "distinct_report",
    "run_records",
    "objective_statistics",
    "stream_frequent",
)
REPEATS = 2
PUBLISHED = {"130k": 130_000, "1300k": 1_300_000, "13000k": 13_000_000}


def finish(df) -> None:
    """Compute every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def made_points(spark, rows: int):
    axes = F.array(*[F.randn(seed) * 10 for seed in range(7)])
    label = F.when(F.col("id") % 13 < 10, "A").otherwise("B")
    return spark.range(0, rows, 1, 16).select("id", axes.alias("coords"), label.alias("label"))


def rounds_over(points) -> float:
    with persisted(dealt(points, 16)) as held:
        held.count()
        return round(min(timed(lambda: mr_fair_fft(held, 8, 2, 16)) for _ in range(3)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="12g", app="bench")
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        run = lambda: finish(queries[name](spark, sf_dir))  # noqa: B023, E731
        seconds[name] = round(min(timed(run) for _ in range(REPEATS)), 3)
    seconds["mr_rounds_k10_l16"] = rounds_over(tables.order_points(spark, sf_dir))
    for name, rows in PUBLISHED.items():
        seconds[f"mr_rounds_{name}"] = rounds_over(made_points(spark, rows))
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()

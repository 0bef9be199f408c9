import hashlib
import random
from collections import Counter

import pytest

from fairstream.functions.hashing import coin, hash_pairs, universal_hash
from fairstream.functions.quality import classify
from fairstream.operators import distinct, frequency as fq
from fairstream.operators.selection import kth_smallest
from fairstream.plans.experiments import quality_runs


def skewed(count, seed=0, low=-30):
    """A third of the arrivals is one item; some items agree modulo the hash prime."""
    rng = random.Random(seed)
    pool = [int(rng.expovariate(0.08)) + low for _ in range(count)]
    return [5 if rng.random() < 0.33 else x + 8191 * (rng.random() < 0.1) for x in pool]


def frame(spark, items, parts=5):
    rows = list(enumerate(items))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "seq bigint, item bigint").repartition(parts)


def heads(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16)


def simulate(items, run, key=lambda i: i):
    """Exact counts, sticky sample and reported items, one arrival after the other."""
    exact, sticky, found = Counter(), {}, set()
    matrix = [[0] * run.width for _ in range(run.depth)]
    for i, x in enumerate(items):
        exact[x] += 1
        if x in sticky:
            sticky[x] += 1
        elif heads(run.seed, key(i)) <= run.winning:
            sticky[x] = 1
        least = float("inf")
        for row, (a, b) in zip(matrix, run.pairs):
            row[((a * x + b) % run.prime) % run.width] += 1
            least = min(least, row[((a * x + b) % run.prime) % run.width])
        if least >= run.phi * run.n:
            found.add(x)
    return exact, sticky, found, matrix


def pairs(df):
    return {r.item: r.n for r in df.collect()}


RUNS = [
    fq.Frequency(2000, 0.02, 0.01, seed=3, width=25),
    fq.Frequency(2000, 0.05, 0.02, seed=4, width=60, depth=3),
    fq.Frequency(2000, 0.01, 0.0005, seed=5, width=7, depth=2),  # sampled with certainty
    fq.Frequency(9000, 0.02, 0.01, seed=6, width=10),  # stream shorter than n
]


@pytest.mark.parametrize("run", RUNS)
def test_against_simulation(spark, run):
    items = skewed(2000, seed=run.seed)
    df = frame(spark, items)
    exact, sticky, found, matrix = simulate(items, run)
    assert pairs(fq.histogram(df)) == exact
    assert pairs(fq.true_frequent(df, run)) == {x: n for x, n in exact.items() if n >= run.phi * run.n}
    assert pairs(fq.sticky_sample(df, run)) == sticky
    assert fq.sample_size(df, run).head()[0] == len(sticky)
    enough = {x: n for x, n in sticky.items() if n >= (run.phi - run.epsilon) * run.n}
    assert pairs(fq.sticky_frequent(df, run)) == enough
    cells = {(r.r, r.c): r.n for r in fq.countmin_matrix(df, run).collect()}
    assert cells == {(r, c): n for r, row in enumerate(matrix) for c, n in enumerate(row) if n}
    for block in (fq.BLOCK, 64, 1):
        assert pairs(fq.countmin_frequent(df, run, block)) == {x: exact[x] for x in found}
    missing = {x for x, n in exact.items() if n >= run.phi * run.n} - found
    assert not missing


def test_certain_sampling_is_exact(spark):
    run, df = RUNS[2], frame(spark, skewed(2000))
    assert run.chance >= 1
    assert pairs(fq.sticky_sample(df, run)) == pairs(fq.histogram(df))


def test_online_answer_may_be_smaller_than_the_final_sketch(spark):
    run = fq.Frequency(2000, 0.02, seed=6, width=25)
    items = skewed(2000, seed=6)
    exact, _, found, matrix = simulate(items, run)
    final = {
        x
        for x in exact
        if min(row[((a * x + b) % run.prime) % run.width] for row, (a, b) in zip(matrix, run.pairs))
        >= run.phi * run.n
    }
    assert found < final
    assert set(pairs(fq.countmin_frequent(frame(spark, items), run))) == found


@pytest.mark.parametrize("spans", [64, 0])
def test_any_numbering_of_arrivals(spark, monkeypatch, spans):
    """Gaps, negative and huge ``seq`` do not matter, only the order does."""
    monkeypatch.setattr(fq, "MAX_SPANS", spans)
    run, items = RUNS[0], skewed(2000, seed=3)
    exact, _, found, _ = simulate(items, run)
    rows = [((i - 900) * 5 + i % 3 + (i > 1990) * 2**62, x) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "seq bigint, item bigint").repartition(5)
    for block in (fq.BLOCK, 100):
        assert pairs(fq.countmin_frequent(df, run, block)) == {x: exact[x] for x in found}


def test_crossing_blocks_are_pushed_to_the_scan(spark, tmp_path):
    frame(spark, skewed(2000, seed=3)).write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    plan = fq.cell_crossings(df, [RUNS[0]], block=100)._jdf.queryExecution().executedPlan().toString()
    pushed = [p for p in plan.split("PushedFilters: ")[1:] if "GreaterThanOrEqual(seq" in p]
    assert plan.count("FileScan") == 1 and pushed


def test_large_tables_leave_the_joins_to_the_optimizer(spark, monkeypatch):
    run, items = RUNS[0], skewed(2000, seed=3)
    monkeypatch.setattr(fq, "BROADCAST_ROWS", 0)
    df = frame(spark, items)
    exact, sticky, found, _ = simulate(items, run)
    assert pairs(fq.sticky_sample(df, run)) == sticky
    assert pairs(fq.countmin_frequent(df, run, 64)) == {x: exact[x] for x in found}


def test_prefix_and_report(spark):
    items = skewed(500)
    df = fq.stream_prefix(frame(spark, items), 321)
    assert pairs(fq.histogram(df)) == Counter(items[:321])
    rows = fq.report(fq.histogram(df).filter("n > 3"), fq.histogram(df)).collect()
    expected = sorted((x, n) for x, n in Counter(items[:321]).items() if n > 3)
    assert [tuple(r) for r in rows] == expected


def test_hash_is_never_negative(spark):
    xs = [-5, -8191, 0, 5, 8191, 2**62, -(2**63)]
    df = spark.createDataFrame([(x,) for x in xs], "item bigint")
    got = {r.item: r.h for r in df.select("item", universal_hash("item", 8190, 7, 13).alias("h")).collect()}
    assert got == {x: ((8190 * x + 7) % 8191) % 13 for x in xs}
    assert all(1 <= a < 8191 and 0 <= b < 8191 for a, b in hash_pairs(200, 1))


def test_coin_is_reproducible(spark):
    df = spark.range(100)
    got = {r.id: r.u for r in df.select("id", coin(9, "id").alias("u")).collect()}
    assert got == {i: heads(9, i) / 2**60 for i in range(100)}


def test_classes(spark):
    df = spark.createDataFrame([(71,), (69,), (31,), (29,)], "f bigint")
    kinds = [r.k for r in df.select(classify("f", 1000, 0.07, 0.04).alias("k")).collect()]
    assert kinds == ["frequent", "almost", "almost", "rare"]


def test_quality_runs(spark):
    items = skewed(1500, seed=8)
    n, phi, seeds = len(items), 0.02, (1, 2, 3)
    found = quality_runs(frame(spark, items), n, phi, (0.01, 0.015), (15, 40), 0.01, seeds).collect()
    got = {(r.algorithm, r.param, r.run): (r.frequent, r.almost, r.rare, r["size"]) for r in found}
    expected = {}
    for number, seed in enumerate(seeds):
        for e in (0.01, 0.015):
            run = fq.Frequency(n, phi, e, seed=seed)
            exact, sticky, _, _ = simulate(items, run)
            said = [x for x, c in sticky.items() if c >= (phi - e) * n]
            expected["sticky", e, number] = (*grades(exact, said, n, phi, e), len(sticky))
        for w in (15, 40):
            run = fq.Frequency(n, phi, 0.01, seed=seed, width=w)
            exact, _, said, _ = simulate(items, run)
            expected["countmin", float(w), number] = (*grades(exact, said, n, phi, 0.01), len(said))
    assert got == expected


def grades(exact, said, n, phi, epsilon):
    high = sum(exact[x] >= n * phi for x in said)
    mid = sum(n * phi > exact[x] >= n * (phi - epsilon) for x in said)
    return high, mid, len(said) - high - mid


def test_runs_without_answers_count_as_zero(spark):
    rows = quality_runs(frame(spark, list(range(200))), 200, 0.5, (0.1,), (150,), 0.1, (1, 2)).collect()
    assert len(rows) == 4 and all((r.frequent, r.almost, r.rare) == (0, 0, 0) for r in rows)
    averages = fq.quality_averages(spark.createDataFrame(rows)).collect()
    assert len(averages) == 2


@pytest.mark.parametrize("values", [[3], [0, 0, 0, 7], list(range(-500, 3000, 3)), [-(2**63), 2**63 - 1, 5]])
def test_kth_smallest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in {1, len(values) // 2 or 1, len(values)}:
        assert kth_smallest(df, "v", k) == sorted(values)[k - 1]
    assert kth_smallest(df, "v", len(values) + 1) is None


@pytest.mark.parametrize("threshold,kept", [(0, 0), (1, 1), (4, 1), (5, 2), (9, 3), (99, 3)])
def test_batches_are_taken_whole(spark, threshold, kept):
    rows = [(0, 9)] * 4 + [(1, -1), (1, 2), (1, 9)] + [(2, 3)] * 3
    df = distinct.whole_batches(spark.createDataFrame(rows, "batch bigint, item bigint"), threshold)
    assert df.select("batch").distinct().count() == kept
    expected = [x for b, x in rows if b < kept]
    assert tuple(distinct.distinct_report(df).head()) == (
        len(expected), len(set(expected)), max(expected, default=None),
    )
    assert distinct.distinct_by_batch(df).count() == len({r for r in rows if r[0] < kept})
    assert {r.batch: r["size"] for r in distinct.batch_sizes(df).collect()} == Counter(
        b for b, _ in rows if b < kept
    )


def test_small_chances_keep_their_size():
    run = fq.Frequency(10**13, 0.02, 0.01)
    assert run.winning == int(run.chance * 2**60) and abs(run.winning / 2**60 / run.chance - 1) < 1e-7


def test_prefix_with_gaps(spark):
    items = frame(spark, range(50)).selectExpr("seq * 9 + 4 AS seq", "item")
    assert sorted(r.item for r in fq.stream_prefix(items, 5).collect()) == [0, 1, 2, 3, 4]
    assert fq.stream_prefix(items, 0).count() == 0 and fq.stream_prefix(items, 99).count() == 50

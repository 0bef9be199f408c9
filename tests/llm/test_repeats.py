"""Periodic runs against a plain search over all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairstream.llm import queries, repeats

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every maximal stretch of each period in turn; a stretch keeps its first, smallest period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n):
    """Words in which stretches of several periods follow one another and overlap."""
    words = []
    while len(words) < n:
        period = rng.integers(0, rng.choice([1, 2, 3, 40]), rng.integers(1, 9)).tolist()
        words += (period * 12)[: rng.integers(1, 12 * len(period) + 1)]
    return words[:n]


@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
@settings(max_examples=300, deadline=None)
def test_short_texts(texts):
    assert repeats.runs_of([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_overlapping_periods(seed):
    rng = np.random.default_rng(seed)
    texts = [periodic(rng, n) for n in (0, 5, 80, 300, 700)]
    assert repeats.runs_of([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_equal_hashes_of_openings(monkeypatch):
    """Openings that share a hash are told apart by their words."""
    monkeypatch.setattr(repeats, "_MIX", (np.uint64(0), np.uint64(0)))
    rng = np.random.default_rng(3)
    texts = [periodic(rng, 200), list(range(60)), periodic(rng, 90)]
    assert repeats.runs_of([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_very_long_texts():
    """Whole texts in near-linear time: one word, two words, a passage between unlike words."""
    n = 300_000
    assert repeats.runs_of([np.ones(n, np.int64)]) == [[(0, n, 1)]]
    assert repeats.runs_of([np.arange(n) % 2]) == [[(0, n, 2)]]
    passage = np.concatenate([np.r_[100 + i, np.arange(20)] for i in range(n // 21)])
    assert repeats.runs_of([passage]) == [[]]


def test_operator_by_hand(spark):
    rows = [(1, "x a b a b\n a b  a b y"), (2, "z z z z z"), (3, "z z z z z z z"), (None, None), (4, " \t"), (4, "é é " * 6), (4, "é é " * 6)]
    found = repeats.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in found)
    assert got == [
        (0, [], ""), (1, [(1, 8, 2)], "x a b y"), (2, [], "z z z z z"), (3, [(0, 7, 1)], "z"),
        (4, [], ""), (4, [(0, 6, 1)], "é é"), (4, [(0, 6, 1)], "é é"),
    ]


def test_query_against_the_contract(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF_DIR).collect()}
    assert len(found) == len(docs)
    seen = 0
    for d in docs:
        words = d.text.encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs, r = plain_runs(words), found[d.doc_id]
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        shown = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        seen += len(runs)
    assert seen > 10

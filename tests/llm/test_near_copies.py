"""The near copies that the pipeline drops, against brute force at similarity 0.8."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairstream.llm import jaccard, simhash

DOCS = "doc_id bigint, text string"


def _shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(docs):
    """Smallest ids of the components of all pairs at 0.8 or more."""
    sets, parent = {i: _shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small < 0.8 * large:
                continue
            shared = len(sets[a] & sets[b])
            if docs[a] == docs[b] or large == 0 or shared >= 0.8 * (small + large - shared):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {top(i) for i in ids}


def _edited(rng, words, edits):
    words = list(words)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"new{rng.integers(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("block_rows", [jaccard.BLOCK_ROWS, 7])
def test_families(spark, block_rows):
    """Near and less near copies of many lengths, in one block and dealt over many."""
    rng = np.random.default_rng(11)
    docs = {}
    for length in (6, 20, 60, 150, 400, 1200):
        for _ in range(4):
            words = [f"w{x}" for x in rng.integers(0, 5000, length)]
            for _ in range(9):
                docs[len(docs)] = _edited(rng, words, rng.integers(0, 2 + length // 25))
    docs |= {len(docs): "", len(docs) + 1: None, len(docs) + 2: "two words", len(docs) + 3: "Two  words"}
    found = simhash.drop_near_copies(spark.createDataFrame(list(docs.items()), DOCS), block_rows=block_rows)
    expected = _kept(docs)
    assert len(expected) < len(docs) - 50
    assert sorted(r.doc_id for r in found.collect()) == sorted(expected)


def test_documents(spark):
    """The test documents, and a pair of the large ones that differs in five bits."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == sorted(_kept(texts))
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    assert [r.doc_id for r in simhash.drop_near_copies(large.filter(F.col("doc_id").isin(0, 7818))).collect()] == [0]


def test_one_id_with_unequal_texts(spark):
    """Unique texts under one id all stay; a copy of one of them goes, whatever its id."""
    words = [f"w{i}" for i in range(40)]
    one, two, other = " ".join(words), " ".join(reversed(words)), " ".join(f"x{i}" for i in range(40))
    rows = [(5, one), (5, two), (5, other), (6, two), (None, one), (None, "alone here"), (None, "alone here")]
    found = simhash.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in found) == sorted([(5, one), (5, two), (5, other), (-1, "alone here")])


def test_texts_that_share_a_hash(spark, monkeypatch):
    """The first key alone decides nothing: here all texts share it."""
    keys = lambda text: [F.lit(7).cast("bigint"), F.xxhash64(text)]
    monkeypatch.setattr(jaccard, "text_keys", keys)
    rows = [(i, f"text {i % 5} " * 12) for i in range(20)]
    found = simhash.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3, 4]


def _counted_links(spark, n, block_rows):
    """One family of ``n`` texts with 0 to 5 edits of a template, as the check tables have it."""
    rng = np.random.default_rng(n)
    words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    docs = {i: _edited(rng, words, int(rng.integers(0, 6))) + f" e{i}" for i in range(n)}
    texts = spark.createDataFrame(list(docs.items()), "fp bigint, text string")
    sketches = texts.mapInArrow(jaccard._keys, "fp bigint, keys array<bigint>, words bigint, bits bigint")
    crowded = sketches.select(F.lit(0).cast("bigint").alias("root"), "fp", "words", "bits")
    links, left = jaccard._thinned(crowded, texts, 0.8)
    rows = jaccard._dealt(left, block_rows).count()
    return docs, rows, links.count(), jaccard.near_links(texts, block_rows=block_rows).count()


def test_work_grows_with_the_family(spark):
    """Rows of texts in blocks and links grow with the texts, not with their square."""
    counted = {n: _counted_links(spark, n, 100)[1:] for n in (500, 1000, 2000)}
    for n, (rows, to_pivot, links) in counted.items():
        assert rows <= 3 * n and to_pivot < n and links <= 2 * n, counted


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_family_of_edits(spark, block_rows):
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    docs = {i: _edited(rng, words, int(rng.integers(0, 7))) for i in range(250)}
    others = [f"y{x}" for x in rng.integers(0, 5000, 120)]
    docs |= {250 + i: _edited(rng, others[:60] + words[:60], int(rng.integers(0, 3))) for i in range(100)}
    found = simhash.drop_near_copies(spark.createDataFrame(list(docs.items()), DOCS), block_rows=block_rows)
    assert sorted(r.doc_id for r in found.collect()) == sorted(_kept(docs))


def test_bit_sliced_distances():
    from fairstream.llm.bitslices import near_counts

    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = np.array([int(b) ^ sum(1 << int(i) for i in set(rng.integers(0, 64, rng.integers(0, 25)))) for b in np.repeat(base, 500)], np.uint64)
    got = {(x, y): d for step in near_counts(values) for x, y, d in zip(*(s.tolist() for s in step))}
    apart = np.bitwise_count(values[:, None] ^ values)
    expected = {(x, y): int(apart[x, y]) for x, y in zip(*np.nonzero(np.triu(apart < 16, 1)))}
    assert got == expected

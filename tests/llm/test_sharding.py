"""Shards against a plain cut of the sorted rows, and the law they keep."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairstream.llm import queries, sharding

DOCS = "doc_id bigint, text string"
SF_DIR = "/root/testdata/sf0.01"


def plain_shards(rows, shards):
    """Rows ``(keys, size)`` in order of their keys, cut at the boundaries nearest to the targets."""
    rows = sorted(rows)
    upto = np.r_[0, np.cumsum([size for _, size in rows])]
    cuts = []
    for j in range(1, shards):
        target = j * int(upto[-1]) / shards
        at = int(np.searchsorted(upto, target, side="right"))
        cuts.append(at - 1 if target - upto[at - 1] <= upto[at] - target else at)
    return [sum(c <= i for c in cuts) for i in range(len(rows))], rows


@pytest.mark.parametrize("parts_a_shard, probes", [(1, 3), (3, 16)])
def test_exact_cut(spark, parts_a_shard, probes):
    """Without tolerance each boundary is the nearest of all; a hot text and a hot id are split."""
    rng = np.random.default_rng(5)
    hot = "the same text " * 20
    data = [(i, f"{i % 170} " * int(rng.integers(1, 60))) for i in range(300)]
    data += [(i, hot) for i in range(300, 450)] + [(None, hot)] * 70 + [(7, f"w{i}") for i in range(40)] + [(8, None), (9, "")]
    docs = spark.createDataFrame(data, DOCS)
    found = sharding.sharded(docs.withColumn("key", F.xxhash64("text")), 9, parts_a_shard, probes, 0.0).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in found) == sorted((i or -1, t or "") for i, t in data)
    low = -(2**63)
    rows = [((r.key, low if r.doc_id is None else r.doc_id), r.size) for r in found]
    shards, rows = plain_shards(rows, 9)
    if parts_a_shard == 1:
        expected, got = defaultdict(int), defaultdict(int)
        for shard, (keys, _) in zip(shards, rows):
            expected[shard, keys] += 1
        for r in found:
            got[r.shard, (r.key, low if r.doc_id is None else r.doc_id)] += 1
        assert got == expected
    check_law(found, 9, 0.0)


def check_law(found, shards, tolerance):
    total, slots, bytes_ = sum(r.size for r in found), defaultdict(list), defaultdict(int)
    for r in found:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in found)
    assert all(abs(bytes_[s] - total / shards) <= 2 * max(tolerance * total / shards, largest) for s in range(shards))


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries.op12_sharding(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    check_law(found, 40, sharding.TOLERANCE)
    again = {r.doc_id: (r.shard, r.slot) for r in queries.op12_sharding(spark, SF_DIR).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in found}


def test_tolerance_keeps_groups_together(spark):
    """Copies far smaller than the tolerance stay in one shard."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 4)).alias("text"))
    found = sharding.sharded(docs, 4, tolerance=0.05).collect()
    shards = defaultdict(set)
    for r in found:
        shards[r.text].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    check_law(found, 4, 0.05)

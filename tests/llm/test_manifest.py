"""The manifest and its proofs against a plain tree over Python lists."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairstream.llm import manifest

ROWS = "id bigint, grp_name string, value string"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(row):
    levels = [row]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([_h("".join(row[i : i + manifest.ARITY])) for i in range(0, len(row), manifest.ARITY)])
    return levels


def _way(levels, at):
    way = []
    for row in levels[:-1]:
        low = at - at % manifest.ARITY
        way.append(("".join(row[low:at]), "".join(row[at + 1 : low + manifest.ARITY])))
        at //= manifest.ARITY
    return way


def plain(rows):
    """``(group, id, leaf)`` rows -> root and, for each leaf, the sorted list of its proofs."""
    groups = {}
    for group, id_, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(group, []).append(leaf)
    trees = [_levels(leaves) for leaves in groups.values()]
    above = _levels([t[-1][0] for t in trees])
    proofs = {}
    for g, tree in enumerate(trees):
        for at, leaf in enumerate(tree[0]):
            proofs.setdefault(leaf, []).append(_way(tree, at) + _way(above, g))
    return above[-1][0], {k: sorted(v) for k, v in proofs.items()}


def proved(df):
    leaves = df.select("id", "grp_name", manifest.leaf_digest(F.col("id"), F.col("value")).alias("leaf"))
    made = manifest.manifest(leaves, "grp_name", "id", "leaf")
    return made, manifest.proofs(made, made.leaves.select("id", "grp_name", "grp", "at"))


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.mark.parametrize("arity, steps", [(2, 8), (2, 2), (3, 2), (5, 1)])
def test_against_lists(spark, monkeypatch, arity, steps):
    """Groups of sizes about the edges of runs and segments, nulls, repeated ids and rows, many groups."""
    monkeypatch.setattr(manifest, "ARITY", arity)
    monkeypatch.setattr(manifest, "STEPS", steps)
    monkeypatch.setattr(manifest, "WIDTH", arity**steps)
    rng = np.random.default_rng(arity)
    sizes = [1, 2, 3, 4, 5, 9, 16, 17, 25, 26, 40]
    data = [(int(rng.integers(0, 3 * n)), f"g{n:03d}é", f"v{i}") for n in sizes for i in range(n)]
    data += [(None, None, "x")] * 5 + [(5, None, None), (5, "", "t"), (5, "", "t"), (None, "g001é", "q")]
    expected_root, expected = plain([(g, i, _h(_field(i) + _field(v))) for i, g, v in data])
    made, found = proved(spark.createDataFrame(data, ROWS).repartition(3))
    got = {}
    rows = found.withColumn("folded", manifest.folded(F.col("leaf"), F.col("proof"))).withColumn("digest", manifest.proof_digest(F.col("proof"))).collect()
    for r in rows:
        way = [(s.before, s.after) for s in r.proof]
        got.setdefault(r.leaf, []).append(way)
        assert r.folded == made.root and r.digest == _h("".join(a + b for a, b in way))
    assert made.root == expected_root and {k: sorted(v) for k, v in got.items()} == expected


def test_some_requests(spark):
    """Only the leaves asked for come back, each as often as it is asked for."""
    data = [(i, "abc"[i % 3], f"v{i}") for i in range(1500)]
    made, _ = proved(spark.createDataFrame(data, ROWS))
    wanted = made.leaves.filter("id % 100 = 7").select("id", "grp", "at")
    found = manifest.proofs(made, wanted.union(wanted.filter("id = 107"))).collect()
    expected_root, expected = plain([(g, i, _h(_field(i) + _field(v))) for i, g, v in data])
    assert sorted(r.id for r in found) == sorted([*range(7, 1500, 100), 107]) and made.root == expected_root
    for r in found:
        assert [[(s.before, s.after) for s in r.proof]] == expected[r.leaf]


def test_one_leaf_and_none(spark):
    made, found = proved(spark.createDataFrame([(1, None, None)], ROWS))
    row = found.head()
    assert row.leaf == made.root == _h("1:1-") and row.proof == []
    made, found = proved(spark.createDataFrame([], ROWS))
    assert made.root is None and found.collect() == []

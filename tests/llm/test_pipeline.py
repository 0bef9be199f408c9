"""The whole pipeline against plain versions of its stages."""

from collections import Counter

import duckdb
import pyarrow as pa

import corpus_pipeline
from fairstream.llm import langid, queries
from tests.llm.test_near_copies import _kept

SF_DIR = "/root/testdata/sf0.001"


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.learnt_from(docs)
    rows = langid._Rows(model)
    kept = {r.doc_id: r for r in docs.collect() if langid.predict(r.text, rows)[1] >= 0.5}
    kept = {i: kept[i] for i in _kept({i: r.text for i, r in kept.items()})}
    table = pa.table({c: [r[c] for r in kept.values()] for c in docs.columns})
    con = duckdb.connect()
    con.register("documents", table)
    wanted = Counter()
    for doc_id, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({queries.MIX_SQL})").fetchall():
        wanted[doc_id] = taken // size if size else 0
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(r.doc_id for r in found) == +wanted
    assert len(found) > len(kept) and all(r.round_trip for r in found)

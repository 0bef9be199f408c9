"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairstream.llm import html, langid, lattice, licenses, manifest, mixing, pieces, repeats, sharding, simhash, tokencount, topk, urls
from fairstream.llm.queries import URL_RULES, tokenizer_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
VECTORS = "vec_id bigint, embedding array<float>, label int"
LONG = "alpha beta gamma delta " * 20_000 + "x" * 100_000
DOC_ROWS = [
    (1, "the cat sat on the mat", "en", "a", 1),
    (2, "le chat est sur la table", "fr", "b", 1),
    (2, "le chat est sur la table", "fr", "b", 1),
    (3, None, "en", None, None),
    (4, "", None, "a", 0),
    (5, "12 34 !", "en", "a", 0),
    (None, "the dog sat on the mat", "en", "b", 1),
    (None, None, None, None, None),
    (6, LONG, "en", "c", 1),
    (7, "the cat sat on the mat", None, "c", 1),
    (8, "Some words here.\nLicensed under the Apache License, Version 2.0.", "en", "c", 1),
]
CLASHING = "kept count key bucket hot root fp size target position doc source_size found score prefix rank copies first word b n".split()


def _proved(docs):
    leaves = docs.withColumn("leaf", manifest.leaf_digest(F.col("doc_id"), F.col("text")))
    made = manifest.manifest(leaves.select("doc_id", "lang", "leaf"), "lang", "doc_id", "leaf")
    return manifest.proofs(made, made.leaves.select("doc_id", "grp", "at"))


DOC_OPS = {
    "licenses": licenses.scan,
    "langid": langid.identify,
    "langid_filter": langid.drop_undetermined,
    "mix_plan": mixing.mix_plan,
    "mixed": mixing.mixed,
    "simhash": simhash.simhash_components,
    "simhash_filter": simhash.drop_near_copies,
    "pieces": lambda docs: pieces.encoded(docs, tokenizer_file()),
    "sharded": lambda docs: sharding.sharded(docs, 3),
    "manifest": _proved,
    "repeats": repeats.periodic_runs,
    "tokens": lambda docs: tokencount.counted(docs, tokenizer_file()),
}
PAGE_OPS = {
    "html": html.extract,
    "urls": lambda pages: urls.judge(pages, URL_RULES, pages.select(urls.canonical(F.col("url")).alias("key"))),
}
VECTOR_OPS = {
    "lattice": lattice.near_vectors,
    "topk": lambda rows: topk.exact_top_k(rows, F.col("vec_id") % 2 == 0),
}
VECTOR_ROWS = [
    (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [1.0, 0.0, 0.0], 2),
    (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 0.0, 0.0], 1),
    (8, [float("inf"), 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0], 1),
    (10, [2.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [], 1),
]
PAGE_ROWS = [
    (1, "https://x.example.org/en/1?ref=a", "<article><p>One &amp; two<p>three</article>"),
    (2, None, None), (3, "no scheme", ""), (4, "http://WWW.Example.COM", "<<<>&"), (None, "://", "<p>text</p>"),
    (1, "https://x.example.org/en/1?ref=a", "<article><p>One &amp; two<p>three</article>"),
    (5, "http://h.example.net/a/", "<div>" * 3000 + "deep" + "</div>" * 10), (6, "http://h.example.net/a", "word " * 50_000),
]


def _rows(df):
    return sorted(map(str, df.collect()))


def _with_others(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("other"))
    return df


CASES = (
    [(n, f, DOC_ROWS, DOCS) for n, f in DOC_OPS.items()]
    + [(n, f, PAGE_ROWS, PAGES) for n, f in PAGE_OPS.items()]
    + [(n, f, VECTOR_ROWS, VECTORS) for n, f in VECTOR_OPS.items()]
)


@pytest.mark.parametrize("name, op, rows, schema", CASES, ids=[c[0] for c in CASES])
def test_empty_table(spark, name, op, rows, schema):
    assert op(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("name, op, rows, schema", CASES, ids=[c[0] for c in CASES])
def test_edges_and_clashing_columns(spark, name, op, rows, schema):
    df = spark.createDataFrame(rows, schema)
    plain = op(df)
    other = op(_with_others(df))
    assert _rows(plain) == _rows(other.select(*plain.columns))
    if name not in ("licenses", "langid_filter", "simhash_filter", "mixed", "topk"):
        assert plain.count() == len(rows)


@pytest.mark.parametrize("name, op, rows, schema", CASES, ids=[c[0] for c in CASES])
def test_all_null(spark, name, op, rows, schema):
    nothing = (None,) * len(schema.split(", "))
    op(spark.createDataFrame([nothing, nothing], schema)).collect()


def test_documents_by_hand(spark):
    df = spark.createDataFrame(DOC_ROWS, DOCS)
    languages = {r.doc_id: r for r in langid.identify(df).collect() if r.doc_id}
    assert languages[3].lang_pred == languages[4].lang_pred == languages[5].lang_pred == "und"
    assert languages[1].lang_pred in ("en", "fr") and languages[2].lang_pred == "fr"
    found = licenses.scan(df).collect()
    assert [(r.doc_id, r.license, r.first_sentence) for r in found] == [(8, "Apache-2.0", 1)]
    groups = {r.doc_id: r.component_id for r in simhash.simhash_components(df).collect() if r.doc_id}
    assert groups[7] == 1 and groups[4] == 3 and groups[2] == 2
    kept = [r.doc_id for r in simhash.drop_near_copies(df).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 3, 5, 6, 8] and kept.count(None) == 1
    encoded = {r.doc_id: r for r in pieces.encoded(df, tokenizer_file()).collect() if r.doc_id}
    assert all(r.round_trip for r in encoded.values()) and encoded[3].n_pieces == 0


def test_vectors_by_hand(spark):
    df = spark.createDataFrame(VECTOR_ROWS, VECTORS)
    found = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    assert (found[1].n_links, found[2].n_links, found[10].n_links) == (3, 3, 3)
    assert {found[i].component_id for i in (1, 2, 10)} == {1}
    assert all(found[i].n_links == 0 and found[i].kept for i in (3, 4, 5, 6, 7, 8, 9, 11, 12))
    best = [(r.query_id, r.rank, r.vec_id) for r in topk.exact_top_k(df, F.col("vec_id") == 2).collect()]
    assert sorted(best) == [(2, 1, 10), (2, 2, 1), (2, 3, 3), (2, 4, 9), (2, 5, 5)]


def test_pages_by_hand(spark):
    df = spark.createDataFrame(PAGE_ROWS, PAGES)
    texts = {r.page_id: r.text for r in html.extract(df).collect()}
    assert texts[1] == "One & two\n\nthree" and texts[2] == texts[3] == "" and texts[5] == "deep"
    listed = spark.createDataFrame([("h.example.net/a",), (None,)], "key string")
    found = {r.page_id: r for r in urls.judge(df, URL_RULES, listed).collect()}
    assert found[5].verdict == found[6].verdict == "block" and found[5].rule is None
    assert (found[1].rule, found[1].verdict) == ("example.org/en/1", "block")
    assert (found[2].host, found[2].path, found[2].verdict) == ("", "", "allow")
    assert found[4].host == "www.example.com"


def test_pipeline_stages_on_edges(spark):
    docs = spark.createDataFrame(DOC_ROWS, DOCS)
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, "")
        if at < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
        docs = kept
    assert docs.count() > 0

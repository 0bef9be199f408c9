from collections import Counter

import pytest

from fairstream.operators import words
from fairstream.plans.queries import all_queries
from fairstream.sources.files import read_docs

TEXTS = ["a b a", "", "a  b", " lead trail ", "tab\tin word", "\U0001f600 x \U0001f600", "b"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, value string").repartition(3)


def counted(df):
    return {r.word: r.n for r in df.collect()}


def test_all_shapes_agree(docs):
    expected = Counter(w for t in TEXTS for w in t.split(" "))
    assert counted(words.word_count(docs)) == expected
    assert counted(words.word_count_partitioned(docs)) == expected
    for parts in (1, 4):
        assert counted(words.word_count_salted_shuffle(docs, parts)) == expected
        assert counted(words.word_count_salted_map(docs, parts)) == expected


def test_counts_by_document(docs):
    found = {(r.doc_id, r.word): r.n for r in words.doc_word_count(docs).collect()}
    assert found == {(i, w): n for i, t in enumerate(TEXTS) for w, n in Counter(t.split(" ")).items()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_document(rows):
    """Counts of ``(key, text)`` rows, equal keys together."""
    found = Counter()
    for key, text in rows:
        found.update((key, w) for w in (text.split(" ") if text is not None else ()))
    return found


def test_counts_by_document_shuffle_no_words(docs):
    assert "hashpartitioning" not in plan_of(words.doc_word_count(docs))


@pytest.mark.parametrize("most", [0, 2, words.BROADCAST_ROWS])
def test_counts_by_document_of_keys_that_come_again(spark, monkeypatch, most):
    monkeypatch.setattr(words, "BROADCAST_ROWS", most)
    rows = [*enumerate(TEXTS), (1, "b b"), (None, "a a"), (None, ""), (None, None), (0, "a b a"), (0, "c"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, value string").repartition(3)
    found = words.doc_word_count(docs)
    assert dict(found.dtypes) == {"doc_id": "bigint", "word": "string", "n": "bigint"}
    assert Counter({(r.doc_id, r.word): r.n for r in found.collect()}) == by_document(rows)
    assert found.count() == len(by_document(rows))


def test_counts_by_line_of_the_documents(spark, tmp_path):
    query = all_queries()["doc_word_count"]
    texts = [(1, "a b a\n\na"), (2, "\U0001f600 b\nb "), (3, ""), (4, None)]
    for name, more in (("once", []), ("again", [(2, "b\nc\nd d"), (None, "a"), (None, "b a\nb")])):
        rows = texts + more
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        found = query(spark, str(tmp_path / name))
        lines = [((i, k), line) for i, text in rows if text is not None for k, line in enumerate(text.split("\n"))]
        assert Counter({((r.doc_id, r.line), r.word): r.n for r in found.collect()}) == by_document(lines)
        assert found.count() == len(by_document(lines))
        assert more or "hashpartitioning" not in plan_of(found)


def test_report(docs):
    vocabulary = {w for t in TEXTS for w in t.split(" ")}
    mean = sum(map(len, vocabulary)) / len(vocabulary)
    assert words.doc_count(docs).head()[0] == len(TEXTS)
    assert words.distinct_words(docs).head()[0] == len(vocabulary)
    assert words.mean_word_length(docs).head()[0] == pytest.approx(mean)
    row = words.word_report(docs).head()
    assert (row.docs, row.words, row.mean_length) == (len(TEXTS), len(vocabulary), pytest.approx(mean))


def test_documents_from_a_file(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one two\n\nthree\n")
    docs = read_docs(spark, str(tmp_path), 4)
    assert sorted(r.value for r in docs.collect()) == ["", "one two", "three"]
    assert len({r.doc_id for r in docs.collect()}) == 3


def test_one_exchange_with_map_side_sum(docs):
    plan = words.word_count_partitioned(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(word") == 1
    assert "partial_sum" in plan

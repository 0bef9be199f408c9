"""Corpus queries that SQL can express agree with it, and the registry is whole."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import database, difference


@pytest.mark.parametrize("name", sorted(entry.CORPUS_ORACLES))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, name, sf_dir):
    found = entry.queries()[name](spark, sf_dir)
    assert difference(found, database(sf_dir), entry.oracle_sql()[name]) is None


def test_all_operators_and_the_pipeline_are_registered():
    numbers = {n[2:].split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert numbers == {str(n) for n in range(1, 14)} and "pipeline" in entry.queries()


def test_licences_of_full_texts(spark):
    from fairstream.llm import licenses

    def text(*ids):
        sentence = {i: s for s, i in licenses.SENTENCES.items()}
        return "/*\n * " + ". \n * ".join(sentence[i].capitalize() for i in ids) + ".\n */"

    rows = [
        (1, text("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
        (2, text("bsd-grant", "bsd-source", "bsd-binary") + "\n" + text("mit-under")),
        (3, "Copyright me.\n\n" + text("mit-grant", "mit-notice", "mit-as-is")),
        (4, text("gpl-3-later", "gnu-warranty")),
        (5, "All about licenses, but none here."),
        (6, "Licensed under the MIT License. " * 3),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id", "place").collect()
    names = [(r.doc_id, r.license, r.n_sentences) for r in found]
    assert names == [
        (1, "BSD-3-Clause", 4), (2, "BSD-2-Clause", 3), (2, "MIT", 1), (3, "MIT", 3),
        (4, "GPL-3.0-or-later", 1), (6, "MIT", 1), (6, "MIT", 1), (6, "MIT", 1),
    ]

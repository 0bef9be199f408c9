"""Every registered query has SQL and agrees with it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import database, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.all_queries(), entry.oracles.all_oracles()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_entry(spark):
    row = entry.entry(spark).head()
    assert row.n == row.na + row.nb and row.objective > 0

"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from testkit import catalog, compare, oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(ORACLE[name]).fetchdf()
    assert compare.difference(got, want) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

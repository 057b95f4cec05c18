"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)



@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    res = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    if res in ("twin has no rows", "no rows") and SQL.get(name):
        return
    assert res is None, res


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

import pytest

import __spark_entry__ as entry
from siltstone.plans import catalogue
from tests.oracle import differences, tables

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return tables(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tiny, con, name):
    assert differences(catalogue.queries()[name](spark, tiny), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    df = catalogue.queries()[name](spark, tiny)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

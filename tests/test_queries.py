"""Every query that has an SQL twin equals it on the smallest tables; the others run and are stable in their schema."""

import pytest

import __spark_entry__ as entry
from tracemill.plans import catalog
from tracemill.plans.compare import difference, duck

SQL = catalog.oracle_sql()
#: Queries of a minute together on a laptop's core; the driver compares all of them.
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, small, con, name):
    assert difference(entry.queries()[name](spark, small), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "outcome" in df.columns


def test_comparator_sees_a_planted_value(spark, con):
    df = spark.sql("select 1 as a, 2.5 as b union all select 2, 3.5")
    assert difference(df, "select 1 as a, 2.5 as b union all select 2, 3.5", con) == ""
    assert difference(df, "select 1 as a, 2.5 as b union all select 2, 3.6", con)
    assert difference(df, "select 1 as a, 2.5 as c union all select 2, 3.5", con)

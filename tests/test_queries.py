"""Every registered query against its SQL on the smallest tables, with plan checks."""

import pytest

import __spark_entry__ as contract
from tests.oracle import connect, table

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()
# Plans that pair all rows of two sides.
PAIRING = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 180


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in PAIRING), plan
    if name in ORACLE:
        found = duck.sql(ORACLE[name])
        assert got == table(found.columns, found.fetchall())

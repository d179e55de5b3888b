import pytest
from oracle import compare, connect, type_problems

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op") or not n[2:3].isdigit()))
def test_query_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    problem, _ = compare(df.columns, df.collect(), con, SQL[name])
    assert problem is None, problem
    assert not type_problems(df.dtypes, con, SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100

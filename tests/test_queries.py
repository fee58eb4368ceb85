"""Every registered query runs, agrees with its SQL, and keeps to plans that scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, oracle_connection
from conftest import plan_of
from workloads.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def oracle(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, oracle, name):
    df = QUERIES[name](spark, small)
    plan = plan_of(df)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan, f"{name} plans {operator}"
    problem = compare(df, oracle, ORACLE[name])
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 20

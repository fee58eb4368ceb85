"""Queries of the subpackage that SQL can express agree with it; the others are compared in their own tests."""

import pytest

import corpus_pipeline
from compare import compare, oracle_connection
from conftest import plan_of
from lakewarden.llm.queries import ORACLE, QUERIES

#: Native operators have no Python code in any plan.
NATIVE = ("op1_", "op5_", "op6_", "op8_", "op10_")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, small, name):
    assert compare(QUERIES[name](spark, small), oracle_connection(small), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith(NATIVE)))
def test_native_plans_hold_no_python(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "Python" not in plan and "InPandas" not in plan


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_pipeline_runs_its_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)

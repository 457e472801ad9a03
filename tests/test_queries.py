"""Every query of the core against its SQL on the smallest tables, and what the driver relies on."""

import pytest

import __spark_entry__ as entry_point
from mneme.plans import registry
from tests.conftest import DATA
from tests.oracle import compare

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_driver_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    df = entry_point.entry(spark)
    assert df.columns == ["query_id", "point_id", "score", "rank"] and df.count() > 0


def test_plans_limit_before_the_shuffle_and_prune_columns(spark):
    plan = QUERIES["dense_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan
    plan = QUERIES["domain_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "dense" not in plan and "text" not in plan.split("ReadSchema")[-1]

"""Every query of the library itself that has SQL, on the smallest tables; the others run."""

import pytest
from compare import DATA, connection, norm, same

from ponderlake.plans import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_alike_twice(spark, name):
    a, b = (sorted(repr([norm(v) for v in r]) for r in QUERIES[name](spark, SF).collect()) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["partition_counterfactual", "agg_partition_summary", "cosine"])
def test_halves_are_sorted_once(spark, name):
    """Members are put in order once, before they are multiplied by the ways to halve a group."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "hashpartitioning(id" not in plan


def test_members_are_sorted_without_a_lambda(spark):
    """Members under a shuffle are compared by sort_array, not by array_sort's lambda."""
    plan = QUERIES["make_partitions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(transform(" in plan and "array_sort(transform(" not in plan

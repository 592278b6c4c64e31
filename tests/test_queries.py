"""Every checked query against its SQL in DuckDB, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from conftest import SF_DIR
from lakewarden import suite

suite.load_all()
QUERIES, ORACLES = suite.QUERIES, suite.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, con, name):
    problems, rows = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert not problems
    assert rows >= 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_no_pairs_of_everything_and_no_python_in_the_plan(spark, name):
    """Without broadcasts, which small test data would hide behind, no query falls back to comparing all pairs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapPartitions"):
        assert word not in plan


def test_bounds_reach_the_scan(spark):
    plan = plan_of(QUERIES["incremental_read"](spark, SF_DIR))
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_newest_row_is_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["contract_lww_rows"](spark, SF_DIR))
    shuffle = plan.index("Exchange hashpartitioning")
    assert "Partial" in plan[shuffle:] and plan[shuffle:].index("WindowGroupLimit") > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3

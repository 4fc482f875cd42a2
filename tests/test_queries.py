"""Registered queries against their SQL on the smallest tables; ALL_QUERIES=1 runs every one."""

import os
import sys

import pytest

from punctual.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "flights_cleaned", "feature_frame", "loader_rows", "upsert_rows", "ontime_flights", "board_page_flights", "regression_report",
    "gate_checks", "daily_performance", "stored_flight_scan", "saved_pages_parsed", "input_drift", "association_rules", "rolling_folds", "stream_daily_metrics", "firing_alerts",
]
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) == ""


BUILT = sorted(n for n, fn in QUERIES.items() if n not in NAMES and fn.__module__.endswith((".loading", ".cleaning")))  # ALL_QUERIES=1 runs the others too


@pytest.fixture
def nothing_is_stored(monkeypatch):
    """Steps that store a table between hand it on as it is, so that building a query runs little."""
    for name, module in list(sys.modules.items()):
        if name.startswith("punctual.") and hasattr(module, "written"):
            monkeypatch.setattr(module, "written", lambda df, name: df)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", BUILT)
def test_query_can_be_built(spark, nothing_is_stored, name):
    assert QUERIES[name](spark, SF).columns


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["feature_frame", "price_quantiles", "value_runs", "input_drift", "scoring_parity"])
def test_plans_have_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dedup_limits_groups_before_the_shuffle(spark):
    plan = QUERIES["flights_cleaned"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan

"""Every registered query against its SQL on DuckDB, and what its plan may not contain."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

from tallyframe.operators import common
from tallyframe.plans import catalog

ORACLES = catalog.ORACLES
QUERIES = catalog.QUERIES
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def duck(small_dir):
    return connect(small_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small_dir, duck, name):
    frame = QUERIES[name](spark, small_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    assert compare(frame, duck, ORACLES[name]) is None


@pytest.mark.parametrize(
    "name", ["agg8_debt_principal", "reg1_check_register", "reg2_deposit_ledger", "join10_check_match", "join11_deposit_match"]
)
def test_small_tables_are_settled_once(spark, small_dir, name):
    """What is left to run after loan months or register outcomes are settled stays a short plan."""
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 20


def test_entry_lists_the_catalogue():
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= ORACLES.keys()


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["household_id", "month", "inflow", "outflow", "net_cash_flow"]
    assert frame.count() > 0


@pytest.mark.parametrize("name", ["bal5_reconcile_periods", "bal6_checkpoint_periods", "expr15_variance_badge", "win7_latest_and_history"])
def test_periods_are_not_shuffled(spark, small_dir, name):
    """An account's periods unfold last: there are many times more of them than rows."""
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    unfolded = next(i for i, line in enumerate(plan) if "Generate" in line and "explode" in line)
    assert not [line for line in plan[:unfolded] if "Exchange" in line]


@pytest.mark.parametrize("name", ["bal10_checkpoint_deltas", "bal11_save_explanations"])
def test_periods_meet_others_by_account(spark, small_dir, name):
    """Where periods meet notes or checkpoints, no shuffle is keyed by period."""
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(account_id" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "period_start" in line]


def test_read_periods_are_settled(spark, small_dir):
    """The check of stored periods unfolds them once, not once for each of its findings."""
    plan = QUERIES["ver14_stored_reconciliation"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate explode(transform(" in line]


@pytest.mark.parametrize(
    "name", ["join17_prior_closing", "bal6_checkpoint_periods", "bal11_save_explanations", "bal12_goal_progress", "bal12_trajectory"]
)
def test_accounts_of_a_task_stay_as_many(spark, small_dir, monkeypatch, name):
    """More accounts than the least number of tasks can hold are dealt to more tasks."""
    monkeypatch.setattr(common, "KEYS_IN_TASK", 1)
    accounts = spark.read.parquet(f"{small_dir}/customer.parquet").count()
    assert accounts > common.SPREAD
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert dealt and all(f", {accounts})" in line for line in dealt)

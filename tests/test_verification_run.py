"""A whole run: what its checks share is computed once, and a fault of it stays with those that read it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import quality, transfers
from tallyframe.plans import verify
from tallyframe.plans.catalog import quality as Q


def plan_of(df) -> list[str]:
    """The plan as it ran, without the plans of what was held."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines, depth = [], None
    for line in text.split("\n"):
        indent = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if depth is None or indent <= depth:
            depth = indent if "InMemoryTableScan" in line else None
            lines.append(line)
    return lines


@pytest.mark.parametrize("name", ["duplicate_keys", "cross_file_duplicates", "null_merchant_spend"])
def test_checks_read_the_held_ledger(spark, small_dir, name):
    alone = sorted(Q.check_set(spark, small_dir)[name]().collect(), key=str)
    with Q.held_inputs(spark, small_dir) as inputs:
        df = Q.check_set(spark, small_dir, inputs)[name]()
        plan = plan_of(df)
        assert sorted(df.collect(), key=str) == alone
    assert sum("InMemoryTableScan" in line for line in plan) == 1 and not any("FileScan" in line for line in plan)
    # rows grouped by account and more stay where the ledger has dealt them
    assert name == "null_merchant_spend" or not any("Exchange" in line for line in plan)


def test_events_are_paired_once_for_a_run(spark, small_dir, monkeypatch):
    runs, real = [], transfers.apply_pairing
    monkeypatch.setattr(transfers, "apply_pairing", lambda *a, **k: runs.append(1) or real(*a, **k))
    monkeypatch.setattr(Q.quality, "CHECKS", tuple(c for c in quality.CHECKS if c[0] in ("balanced_clusters", "orphan_transfers", "benign_stale")))
    statuses = {r["check"]: r["status"] for r in Q.run_status(spark, small_dir).collect()}
    assert len(runs) == 1
    assert set(statuses) == {"balanced_clusters", "orphan_transfers", "benign_stale"} and "error" not in statuses.values()


def test_a_fault_of_shared_inputs_is_not_one_of_the_check(spark):
    broken = spark.range(2).where(F.raise_error(F.lit("shared")).cast("boolean"))
    find = lambda df: quality.findings(df, "tail_gap", "warn", F.col("id").cast("string"), "seen")
    alone = {"tail_gap": lambda: find(spark.range(3))}
    found = verify.run_checks(spark, {"tail_gap": lambda: find(broken)}, alone=alone).collect()
    assert [r["severity"] for r in found] == ["warn"] * 3


def test_few_benign_entries_leave_rows_in_place(spark):
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("account_id"), "id").repartition(4).cache()
    entries = rows.groupBy("account_id").count().select(F.col("account_id").alias("b_account"), "count")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = quality._met(rows, entries, (("account_id", "b_account"),))
        plan = plan_of(met)
        assert met.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        rows.unpersist()
    assert not any("SortMergeJoin" in line for line in plan)

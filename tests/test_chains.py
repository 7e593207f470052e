"""Intraday chains, income fill and ranking against brute force."""

from __future__ import annotations

import datetime
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import chains, quality
from tallyframe.operators.common import number_copies
from tallyframe.operators.ranges import number_in_group

DAY = datetime.date(2024, 3, 1)
ROWS = "account_id string, occurred_on date, amount decimal(18,2), running_balance decimal(18,2)"


def order_exists(rows):
    """All orders of a small day in which each balance follows from the one before; their openings and closings."""
    found = set()
    for order in itertools.permutations(range(len(rows))):
        seq = [rows[i] for i in order]
        if all(a[1] == b[1] - b[0] for a, b in zip(seq, seq[1:])):
            found.add((seq[0][1] - seq[0][0], seq[-1][1]))
    return found


def random_day(rng):
    n = rng.randint(1, 6)
    balance, rows = rng.randint(0, 5), []
    for _ in range(n):
        amount = rng.choice([-3, -2, -1, 0, 1, 2, 3])
        balance += amount
        rows.append((amount, balance))
    if rng.random() < 0.3:
        i = rng.randrange(n)
        rows[i] = (rows[i][0], rows[i][1] + rng.choice([-1, 1, 10]))
    if rng.random() < 0.2:
        rows += [(5, 105), (-5, 100)]  # a closed loop of its own
    rng.shuffle(rows)
    return rows


def degrees_clear(rows):
    """No row has two possible neighbours, and exactly one row starts and one ends the day."""
    after = [sum(1 for j, b in enumerate(rows) if j != i and b[1] - b[0] == a[1]) for i, a in enumerate(rows)]
    before = [sum(1 for j, b in enumerate(rows) if j != i and b[1] == a[1] - a[0]) for i, a in enumerate(rows)]
    return max(after) <= 1 and max(before) <= 1 and after.count(0) == 1 and before.count(0) == 1


@pytest.mark.parametrize("rounds", [chains.ROUNDS, 1, 0])
def test_chains_match_brute_force(spark, rounds):
    rng = random.Random(7)
    days = {f"a{i:04d}": random_day(rng) for i in range(250)}
    data = [(a, DAY, Decimal(x), Decimal(b)) for a, rows in days.items() for x, b in rows]
    got = {
        r["account_id"]: (r["ambiguous"], r["opening"], r["closing"])
        for r in chains.intraday_chains(spark.createDataFrame(data, ROWS), rounds=rounds).collect()
    }
    kinds = set()
    for account, rows in days.items():
        orders = order_exists(rows) if degrees_clear(rows) or len(rows) == 1 else set()
        clear = len(rows) == 1 or len(orders) == 1
        ambiguous, opening, closing = got[account]
        assert ambiguous == (not clear), (account, rows)
        if clear:
            assert (opening, closing) == next(iter(orders)), (account, rows)
        kinds.add(clear)
    assert kinds == {True, False}


def test_long_day_is_walked_exactly(spark):
    rows = spark.range(5000).select(
        F.lit("a").alias("account_id"), F.lit(DAY).alias("occurred_on"), F.lit(1).cast("decimal(18,2)").alias("amount"),
        (F.col("id") + 1).cast("decimal(18,2)").alias("running_balance"),
    )
    out = chains.intraday_chains(rows).first()
    assert (out["ambiguous"], out["opening"], out["closing"]) == (False, Decimal(0), Decimal(5000))
    loop = spark.createDataFrame([("a", DAY, Decimal(5), Decimal(9005)), ("a", DAY, Decimal(-5), Decimal(9000))], ROWS)
    assert chains.intraday_chains(rows.unionByName(loop)).first()["ambiguous"]


def test_contraction_keeps_ends_and_loops(spark):
    """Two paths and two loops: few edges stay, each path from its start to its end, each loop in itself."""
    paths = [(0, 400), (1000, 1300)]
    loops = [(2000, 2002), (3000, 3150)]
    edges = [(i, i + 1) for a, b in paths for i in range(a, b)] + [(i, i + 1 if i + 1 < b else a) for a, b in loops for i in range(a, b)]
    df = spark.createDataFrame([("k", *e) for e in edges], "account_id string, at long, to long")
    left = chains.contract(df, ["account_id"]).collect()
    assert len(left) < len(edges) / 10
    after = {r["at"]: r["to"] for r in left}
    for a, b in paths:
        at = a
        while at in after:
            at = after.pop(at)
        assert at == b
    for a, b in loops:
        start = at = next(x for x in after if a <= x < b)
        while at in after:
            at = after.pop(at)
        assert at == start
    assert not after


def test_chains_run_nothing_while_planned(spark):
    """Building the plan starts no job, and no task meets a whole day before it is contracted."""
    rows = spark.createDataFrame([("a", DAY, Decimal(1), Decimal(i + 1)) for i in range(5)], ROWS)
    context, group = spark.sparkContext, "chains-planned"
    context.setJobGroup(group, group)
    out = chains.closing_by_day(rows)
    out._jdf.queryExecution().executedPlan()
    assert len(context.statusTracker().getJobIdsForGroup(group)) == 0
    assert out.count() == 1 and len(context.statusTracker().getJobIdsForGroup(group)) > 0
    context.setJobGroup("", "")


@pytest.mark.parametrize("seed", [1, 2])
def test_income_fill_matches_greedy(spark, seed):
    rng = random.Random(seed)
    first = datetime.date(2024, 1, 1)
    data, streams, expected = [], [], {}
    for s in range(40):
        account, need = f"a{s:03d}", rng.choice([1, 2, 3])
        days = sorted(rng.randrange(0, 170) for _ in range(rng.randint(1, 14)))
        dates = [first + datetime.timedelta(days=x) for x in days]
        data += [("h", account, d, Decimal(10), "pay", "payroll", "joint", f"{account}-{i}") for i, d in enumerate(dates)]
        streams.append((f"s{s}", account, "pay", Decimal(1), None, need, None, None))
        left = list(dates)
        for m in range(dates[0].month, 6):
            low, high = datetime.date(2024, m, 1), datetime.date(2024, m + 1, 1) + datetime.timedelta(days=2)
            taken = [d for d in left if low <= d <= high][:need]
            for d in taken:
                left.remove(d)
            expected[(f"s{s}", m)] = len(taken)
    ledger = spark.createDataFrame(
        data, "household_id string, account_id string, occurred_on date, amount decimal(18,2), description_raw string, subcategory string, household_role string, id string"
    )
    table = spark.createDataFrame(
        streams, "name string, account_id string, pattern string, min_amount decimal(18,2), max_amount decimal(18,2), min_per_month int, expected_subcategory string, expected_role string"
    )
    months = spark.createDataFrame([("h", "2024-05")], "household_id string, as_of_month string")
    got = {(r["name"], r["month_start"].month): r["found"] for r in quality.income_fill(ledger, table, months).collect()}
    assert got == {k: v for k, v in expected.items()}


def ranked_by_hand(rows, weight=lambda row: 1):
    """1-based places of (group, order, ...) rows by hand; nulls first."""
    want, at = {}, {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or "")):
        want[row] = at.get(row[0], 0) + 1
        at[row[0]] = at.get(row[0], 0) + weight(row)
    return want


def test_number_in_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("a", "b", None)), f"{rng.randrange(16**6):06x}-{i}", rng.randrange(5)) for i in range(400)] + [("a", None, 2), ("", "x", 1)]
    df = spark.createDataFrame(rows, "g string, id string, w int").repartition(3)
    got = {(r["g"], r["id"], r["w"]): r["rank"] for r in number_in_group(df, ["g"], ["id"]).collect()}
    assert got == ranked_by_hand(rows)
    heavy = {(r["g"], r["id"], r["w"]): r["first"] for r in number_in_group(df, ["g"], ["id"], name="first", weight="w").collect()}
    assert heavy == ranked_by_hand(rows, lambda row: row[2])
    assert number_in_group(df.limit(0), ["g"], ["id"]).collect() == []


def test_number_in_group_spreads_one_group_over_every_task(spark):
    """Ids with a common beginning and one group of all rows: no task holds much more than its share."""
    from tallyframe.session import cut_lineage

    seen = []

    def watched(df):
        laid = cut_lineage(df)
        seen.append([r["count"] for r in laid.groupBy(F.spark_partition_id()).count().collect()])
        return laid

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.lit("one").alias("g"), F.format_string("%020d", F.col("id") * 7 % 4001).alias("id"))
        out = number_in_group(df, ["g"], ["id"], cut=watched).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in sorted(out, key=lambda r: r["id"])] == list(range(1, 4001))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(seen[0]) == tasks and max(seen[0]) < 2 * 4000 / tasks


def test_number_copies(spark, monkeypatch):
    from tallyframe.operators import common

    monkeypatch.setattr(common, "COPY_CHUNK", 3)
    rows = [("f", "p", "x")] * 10 + [("f", "p", "y")] * 2 + [("f", "q", "x")]
    out = number_copies(spark.createDataFrame(rows, "file string, payload string, other string"), ["file", "payload"], F.sha2("other", 256))
    got = sorted((r["payload"], r["ordinal"]) for r in out.collect())
    assert got == [("p", i) for i in range(12)] + [("q", 0)]


def test_each_round_deals_values_anew(spark):
    """Rows that come dealt by day do not run all rounds, and a whole day, in one task."""
    rows = spark.createDataFrame([("a", DAY, Decimal(1), Decimal(i + 1)) for i in range(5)], ROWS).repartition(7, "account_id", "occurred_on")
    plan = chains.intraday_chains(rows)._jdf.queryExecution().executedPlan().toString()
    by_value = [line for line in plan.splitlines() if "Exchange hashpartitioning(account_id" in line and ", v#" in line]
    assert len(by_value) > chains.ROUNDS


def test_large_groups_are_numbered_apart(spark, monkeypatch):
    """Only groups with many rows are folded and spread; all rows are numbered once, in digest order, null keys too."""
    from tallyframe.operators import common

    monkeypatch.setattr(common, "LARGE_GROUP", 4)
    monkeypatch.setattr(common, "COPY_CHUNK", 3)
    spread, folded = [], common._number_folded
    monkeypatch.setattr(common, "_number_folded", lambda df, *rest: spread.append(df.count()) or folded(df, *rest))
    rows = [("f", "p", "x")] * 7 + [("f", "p", "y")] * 2 + [("f", "q", "x")] * 2 + [("f", None, "x")] * 5 + [("f", None, None), (None, "p", "x"), ("g", "p", "z")]
    df = spark.createDataFrame(rows, "file string, payload string, other string")
    out = number_copies(df, ["file", "payload"], F.sha2(F.coalesce("other", F.lit("")), 256)).collect()
    assert sorted((str(r["file"]), str(r["payload"]), r["ordinal"]) for r in out) == sorted(
        [("f", "p", i) for i in range(9)] + [("f", "q", i) for i in range(2)] + [("f", "None", i) for i in range(6)] + [("None", "p", 0), ("g", "p", 0)]
    )
    assert sorted(str(tuple(r)[:3]) for r in out) == sorted(str(row) for row in rows)
    assert {r["ordinal"] for r in out if r["payload"] == "p" and r["other"] == "y"} in ({0, 1}, {7, 8})
    assert spread == [15]

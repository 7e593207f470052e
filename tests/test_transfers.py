"""Pairing against a definition-by-definition check on random ledgers."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import transfers as T

SCHEMA = (
    "household_id string, id string, account_id string, occurred_on date, amount decimal(18,2), direction string, "
    "primary_category string, description_raw string, transfer_group_key string"
)
DAY0 = datetime.date(2024, 1, 1)


def row(i, account, day, amount, household="h", direction="transfer", category="transfer", text="x", group=None):
    return (household, f"r{i:05d}", account, DAY0 + datetime.timedelta(days=day), Decimal(amount), direction, category, text, group)


def random_rows(seed, households=60, most=14):
    rng = random.Random(seed)
    rows, i = [], 0
    for h in range(households):
        if rng.random() < 0.4:  # equal sides on one or two days, sometimes with one row too many
            size, day, gap = rng.choice([2, 2, 3]), rng.randrange(4), rng.choice([0, 1, 3])
            for k in range(size):
                rows.append(row(i, "a0", day + (k % 2) * rng.choice([0, 0, 1]), "-10", household=f"h{h:03d}"))
                rows.append(row(i + 1, "a1", day + gap, "10", household=f"h{h:03d}"))
                i += 2
            if rng.random() < 0.3:
                rows.append(row(i, rng.choice(["a0", "a2"]), day + rng.choice([0, 2]), "10", household=f"h{h:03d}"))
                i += 1
            continue
        span, accounts = rng.choice([3, 8, 20]), rng.choice([2, 2, 3, 4])
        for _ in range(rng.randint(2, most)):
            amount = rng.choice(["10", "-10"]) if rng.random() < 0.85 else rng.choice(["0", "25", "-25"])
            rows.append(row(i, f"a{rng.randrange(accounts)}", rng.randrange(span), amount, household=f"h{h:03d}"))
            i += 1
    return rows


def by_definition(rows, tolerance=5):
    """Best partners, mutual pairs and closed two-account groups, each from its definition."""
    view = {r[1]: r for r in rows}
    best = {}
    for a in rows:
        gaps = defaultdict(list)
        for b in rows:
            gap = abs((a[3] - b[3]).days)
            if a[0] == b[0] and a[2] != b[2] and a[4] * b[4] < 0 and abs(a[4]) == abs(b[4]) and gap <= tolerance:
                gaps[gap].append(b[1])
        best[a[1]] = frozenset(gaps[min(gaps)]) if gaps else frozenset()
    pairs = set()
    for a, partners in best.items():
        if len(partners) == 1 and best[next(iter(partners))] == {a}:
            pairs.add(frozenset({a, next(iter(partners))}))
    unclear = {a for a, partners in best.items() if len(partners) > 1}
    links = defaultdict(set)
    for a in unclear:
        for b in best[a] & unclear:
            links[a].add(b)
            links[b].add(a)
    seen = set()
    for start in sorted(unclear):
        if start in seen:
            continue
        component, todo = set(), [start]
        while todo:
            node = todo.pop()
            if node not in component:
                component.add(node)
                todo += links[node]
        seen |= component
        sides = defaultdict(list)
        for node in sorted(component):
            sides[view[node][2]].append(node)
        if len(sides) != 2:
            continue
        one, two = sides.values()
        if len(one) == len(two) and all(best[n] == set(two) for n in one) and all(best[n] == set(one) for n in two):
            pairs |= {frozenset(p) for p in zip(one, two)}
    return best, pairs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_match_definition(spark, seed):
    rows = random_rows(seed)
    best, expected = by_definition(rows)
    ledger = spark.createDataFrame(rows, SCHEMA)
    found = T.pair_transfers(ledger).collect()
    assert {frozenset({r["left_id"], r["right_id"]}) for r in found} == expected
    assert any(r["kind"] == "group" for r in found) and any(r["kind"] == "mutual" for r in found)
    candidates = T.candidates(ledger)
    cells = T.partner_cells(candidates)
    counts = candidates.join(cells.select(*T.CELL, "partners"), list(T.CELL)).select("id", "partners").collect()
    assert {r["id"]: r["partners"] for r in counts} == {i: len(p) for i, p in best.items()}


def statuses(spark, rows):
    ledger = spark.createDataFrame(rows, SCHEMA)
    candidates = T.candidates(ledger)
    cells = T.partner_cells(candidates)
    out = T.candidate_status(candidates, cells, T.pairs_of(candidates, cells))
    return {r["id"]: (r["status"], r["reason"], r["candidate_count"]) for r in out.collect()}


def test_reasons(spark):
    rows = [
        row(1, "a", 0, "-10"), row(2, "b", 1, "10"), row(3, "c", 3, "10"),  # 3 comes after 1 and 2 have settled
        row(4, "a", 0, "-70"),  # alone with its amount
        row(5, "a", 0, "-30"), row(6, "b", 9, "30"),  # outside the tolerance
        row(7, "a", 0, "-40"), row(8, "a", 1, "40"),  # one account only
        row(9, "a", 0, "-50"), row(10, "b", 0, "-50"),  # same sign
        row(11, "c", 0, "60"), row(12, "a", 2, "-60"), row(13, "b", 2, "60"),  # 11 is early, its partner prefers 13
    ]
    got = statuses(spark, rows)
    assert got["r00001"][0] == got["r00002"][0] == "paired"
    assert got["r00003"] == ("unpaired", T.TAKEN, 1)
    assert got["r00004"] == ("unpaired", T.NO_CANDIDATE, 0)
    assert got["r00005"] == ("unpaired", T.NO_OTHER_ACCOUNT, 0)
    assert got["r00007"] == ("ambiguous", None, 1)
    assert got["r00009"] == ("unpaired", T.NO_OTHER_ACCOUNT, 0)
    assert got["r00011"] == ("unpaired", T.PREFERS_OTHER, 1)
    assert got["r00012"][0] == got["r00013"][0] == "paired"


def test_five_by_five_group_and_hot_amount(spark):
    rows = [row(i, "a", 0, "-5000") for i in range(5)] + [row(10 + i, "b", 0, "5000") for i in range(5)]
    ledger = spark.createDataFrame(rows, SCHEMA)
    pairs = T.pair_transfers(ledger).orderBy("left_id").collect()
    assert [(p["left_id"], p["right_id"]) for p in pairs] == [(f"r{i:05d}", f"r{10 + i:05d}") for i in range(5)]
    uneven = spark.createDataFrame(rows[:-1], SCHEMA)
    assert T.pair_transfers(uneven).count() == 0
    # One amount, two accounts, one day, many rows: no pair list is built on the way.
    many = spark.range(20000).select(
        F.lit("h").alias("household_id"), F.format_string("r%07d", "id").alias("id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("account_id"), F.lit(DAY0).alias("occurred_on"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(-7).cast("decimal(18,2)").alias("amount"), F.lit("transfer").alias("direction"),
        F.lit("transfer").alias("primary_category"), F.lit("x").alias("description_raw"), F.lit(None).cast("string").alias("transfer_group_key"),
    )
    assert T.pair_transfers(many).count() == 10000


def test_direction_and_category_are_both_needed(spark):
    rows = [row(1, "a", 0, "-10"), row(2, "b", 0, "10", category="fixed_obligation"), row(3, "b", 0, "10", direction="inflow")]
    assert T.pair_transfers(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_rearm_and_idempotence(spark):
    def domain():
        return T.inbound_domain(("s",), (r"requested\s+transfer\s+from",))

    rows = [row(1, "s", 0, "100", direction="inflow", text="Requested transfer from X"), row(2, "s", 0, "80", text="Requested transfer from X")]
    once = T.apply_pairing(spark.createDataFrame(rows, SCHEMA), domain=domain())
    first = {r["id"]: (r["direction"], r["rearmed"], r["reclassified"]) for r in once.collect()}
    assert first == {"r00001": ("inflow", True, True), "r00002": ("inflow", False, True)}
    # The other leg arrives later: the row pairs instead of staying an inflow.
    later = spark.createDataFrame([*rows, row(3, "c", 1, "-100")], SCHEMA)
    again = T.apply_pairing(later, domain=domain())
    keys = {r["id"]: (r["direction"], r["transfer_group_key"]) for r in again.collect()}
    assert keys["r00001"][0] == "transfer" and keys["r00001"][1] == keys["r00003"][1] is not None
    third = T.apply_pairing(again.select(*later.columns), domain=domain())
    assert {r["id"]: (r["direction"], r["transfer_group_key"]) for r in third.collect()} == keys
    counts = T.run_counts(third).first()
    assert counts["pairs_created"] == 0 and counts["already_paired"] == 2


@pytest.mark.parametrize("seed", [4, 5])
def test_suspected_legs(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(seed, households=25)
    extra = [
        row(90000 + i, f"a{rng.randrange(4)}", rng.randrange(20), "10", household=f"h{rng.randrange(25):03d}", direction="inflow", category="income")
        for i in range(150)
    ]
    ledger = spark.createDataFrame(rows + extra, SCHEMA)
    pairs = T.pair_transfers(ledger)
    view = {r[1]: r for r in rows}
    legs = []
    for p in pairs.collect():
        for leg, name in enumerate(("left_id", "right_id")):
            order = (p["kind"] != "mutual", p["left_day"], p["left_id"], leg)
            legs.append((order, p[name], view[p[name]], {p["left_account"], p["right_account"]}))
    expected = {}
    for r in extra:
        fitting = [(o, i) for o, i, leg, accounts in legs if leg[0] == r[0] and abs(leg[4]) == abs(r[4]) and abs((leg[3] - r[3]).days) <= 5 and r[2] not in accounts]
        if fitting:
            expected[r[1]] = min(fitting)[1]
    got = {r["id"]: r["likely_partner_id"] for r in T.suspected_untagged(ledger, pairs).collect()}
    assert got == expected and expected


def test_clusters_net_to_zero_across_accounts(spark):
    rows = [row(1, "a", 0, "-10"), row(2, "b", 4, "10"), row(3, "a", 20, "-10"), row(4, "a", 22, "10"), row(5, "b", 40, "10")]
    found = T.unpaired_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["id"]: r["in_cluster"] for r in found} == {"r00001": True, "r00002": True, "r00003": False, "r00004": False, "r00005": False}

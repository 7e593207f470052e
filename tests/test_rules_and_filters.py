"""Rule semantics, read-only SQL, ranges, goal line, registers, balances: one trap each."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_ingest import frame, ledger_row, no_overrides

from tallyframe.functions import scalars as S
from tallyframe.operators import balances, dashboard, filters, loans, quality, registers, rules, summaries
from tallyframe.operators import overrides as O
from tallyframe.plans import verify
from tallyframe.schema import PERIODS, RULES

STAMP = datetime.datetime(2026, 1, 1)


def rule(i, pattern, priority=10, direction=None, category=None, sub=None, account=None):
    return (i, pattern, account, direction, category, sub, None, None, None, "high", priority, STAMP)


def loaded(spark, *rows):
    return rules.load_rules(spark.createDataFrame(list(rows), RULES))


def test_rule_order_and_outputs(spark):
    book = loaded(
        spark, rule("z", "shop", 1), rule("b", "shop", 10, sub=""), rule("a", "shop", 10, category="medical"),
        rule("c", "gym", 5, direction="inflow", category="income"), rule("d", "gym", 20, category="tax", account="other"),
    )
    rows = frame(spark, ledger_row(1, "a", "2026-01-01", "-5", "outflow", text="SHOP 1", subcategory="old"), ledger_row(2, "a", "2026-01-01", "-5", "outflow", text="gym"))
    out = {r["id"]: r for r in rules.classify(rows, book, no_overrides(spark)).collect()}
    # A rule without outputs is passed over; equal priority goes by id; a null output leaves the field.
    assert (out["r1"]["primary_category"], out["r1"]["subcategory"]) == ("medical", "old")
    assert out["r2"]["primary_category"] == "unclassified"
    blank = loaded(spark, rule("b", "shop", 10, sub=""))
    assert rules.classify(rows, blank, no_overrides(spark)).where("id = 'r1'").first()["subcategory"] == ""


def test_override_protection_and_counts(spark):
    book = loaded(spark, rule("a", ".", category="medical"))
    rows = frame(spark, ledger_row(1, "a", "2026-01-01", "-5", "outflow", category="tax"), ledger_row(2, "a", "2026-01-02", "-5", "outflow", category="tax"))
    held = O.upsert_overrides(no_overrides(spark), O.override_requests(rows.where("id = 'r1'"), lifecycle="seasonal"))
    out = {r["id"]: (r["primary_category"], r["lifecycle"]) for r in rules.classify(rows, book, held, reclassify_all=True).collect()}
    assert out == {"r1": ("tax", "seasonal"), "r2": ("medical", "recurring")}
    counts = rules.classify_counts(rows, book, held, reclassify_all=True).first()
    assert tuple(counts) == (2, 1, 1)
    # A partial override wins over a rule that classified its row.
    fresh = rows.withColumn("primary_category", F.lit("unclassified"))
    out = {r["id"]: (r["primary_category"], r["lifecycle"]) for r in rules.classify(fresh, book, held).collect()}
    assert out["r1"] == ("medical", "seasonal")


PATTERNS = (
    "amazon", r"\bamzn\b|prime", "whole foods|wholefds", ".+", "^small", "a{2,}bc", "(?:coffee|tea) house", "co(?:ff|rn)ee?shop", r"check#\s*\d+", "x+yz?abc", r"a\.b\.c",
    r"\Qa+b\E", "[a-z]{3}", "[[a-c]x]yz", r"\x41bc", "(?x) s p a c e d", "é cole", r"100\%", "(?i)ring$", "|empty", "((a|b)(c|d))efg", "ab*", "foo+?bar", r"\\\\share", "(?u)kelvin",
    "under_score", "tr.nsfer", "zahlung(?= an)", "ÄRGER", "a-b/c", r"\p{Lu}bc", r"(..)\1", "half(", "A",
)
TEXTS = (
    "AMAZON mktp", "AMZN digital", "amazing PRIME", "WHOLEFDS 12", "small ring", "aaBC", "Tea House 9", "coffeeshop", "cornshop", "corneshop", "CHECK# 12", "xxyabc", "a.b.c", "a+b", "xyz",
    "Abc", "spaced", "é Cole", "100%", "the RING", "", " ", "adefg", "acEFG", "fooobar", r"\\share", "Kelvin", "UNDER_SCORE", "transfer", "TRANSFER", "Zahlung an", "Ärger", "ärger", "a-b/c",
    "abab", "漢字 amazon", "half(", "no match at all", None,
)


def test_a_required_text_stands_in_every_match(spark):
    """Whatever a pattern matches holds one of its required texts."""
    from tallyframe.operators import rule_index

    book = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    texts = {r["pattern"]: r["t"] for r in book.select("pattern", rule_index.required_texts(F.col("pattern")).alias("t")).collect()}
    assert texts["amazon"] == ["amazon"] and texts[r"\bamzn\b|prime"] == ["amzn", "prime"] and texts["a{2,}bc"] == [] and texts["tr.nsfer"] == ["nsfer"]
    assert texts["(?:coffee|tea) house"] == [" house"] and texts["foo+?bar"] == ["foo"] and texts["ab*"] == [] and texts[r"check#\s*\d+"] == ["check#"]
    valid = book.where("pattern <> 'half('").withColumn("needed", rule_index.required_texts(F.col("pattern")))
    met = valid.crossJoin(spark.createDataFrame([(t,) for t in TEXTS], "text string")).where(F.rlike(F.col("text"), F.concat(F.lit("(?i)"), F.col("pattern"))))
    holds = F.exists("needed", lambda t: F.contains(rule_index.folded(F.col("text")), t)) | (F.size("needed") == 0)
    assert met.count() > len(TEXTS) and met.where(~holds).collect() == []


def test_joined_rules_are_those_of_the_expression(spark):
    """Both forms give every row the same rule: filters, ties, nulls, alternations, patterns without a required text."""
    valid = [p for p in PATTERNS if p not in ("half(",)]
    book = [
        rule(f"r{i:03d}", p, priority=(i * 7) % 5 if p != ".+" else 9, direction=(None, "inflow", "")[i % 3], account=(None, None, "a", "")[i % 4], category=None if i % 9 == 8 else f"c{i}")
        for i, p in enumerate(valid * 2)
    ]
    table = spark.createDataFrame(book, RULES)
    rows = frame(spark, *[ledger_row(i, "ab"[i % 2], "2026-01-01", "-5", ("inflow", "outflow")[i // 2 % 2], text=t) for i, t in enumerate(t for t in TEXTS * 4)])
    rows = rows.withColumn("account_id", F.when(F.col("id") != "r3", F.col("account_id")))
    eligible = F.col("id") != "r5"
    short = {r["id"]: r["match"] for r in rules.match_rules(rows, rules.load_rules(table), eligible).collect()}
    long = {r["id"]: r["match"] for r in rules.match_rules(rows, table, eligible).collect()}
    assert short == long and len(long) == 4 * len(TEXTS) and sum(m is not None for m in long.values()) > len(TEXTS)
    written = [{r["id"]: r for r in rules.classify(rows, book, no_overrides(spark)).collect()} for book in (table, rules.load_rules(table))]
    assert written[0] == written[1]
    assert {r["match"] for r in rules.match_rules(rows, table.limit(0)).collect()} == {None}


def test_fifty_thousand_rules(spark):
    """No table of rules is refused, and a join tests few pairs of it."""
    n = 50_000
    table = spark.range(n).select(
        F.format_string("r%05d", "id").alias("id"), F.format_string("merchant %05d$", "id").alias("pattern"), F.lit(None).cast("string").alias("account_filter"),
        F.lit(None).cast("string").alias("direction_filter"), F.format_string("c%d", "id").alias("primary_category"), *[F.lit(None).cast("string").alias(c) for c in ("subcategory", "merchant_normalized", "household_role", "lifecycle")],
        F.lit("high").alias("confidence"), F.lit(10).alias("priority"), F.lit(STAMP).alias("created_at"),
    )
    loaded_rules = rules.load_rules(table)
    assert not isinstance(loaded_rules, list)
    rows = frame(spark, *[ledger_row(i, "a", "2026-01-01", "-5", "outflow", text=f"MERCHANT {i * 99:05d}") for i in range(60)], ledger_row(999, "a", "2026-01-01", "-5", "outflow", text="merchant 1"))
    got = {r["id"]: r["match"] and r["match"]["primary_category"] for r in rules.match_rules(rows, loaded_rules).collect()}
    assert got == {f"r{i}": f"c{i * 99}" for i in range(60)} | {"r999": None}


def test_many_rules_use_blocks(spark):
    book = loaded(spark, *[rule(f"r{i:04d}", f"word{i}$", 10, category=f"c{i}") for i in range(450)])
    rows = frame(spark, ledger_row(1, "a", "2026-01-01", "-5", "outflow", text="word449"), ledger_row(2, "a", "2026-01-01", "-5", "outflow", text="none"))
    got = {r["id"]: r["match"] for r in rules.match_rules(rows, book).collect()}
    assert got["r1"]["rule_id"] == "r0449" and got["r2"] is None


def test_a_check_that_fails_as_it_runs_is_one_finding(spark):
    good = quality.findings(spark.range(2), "vocabulary", "fail", F.col("id").cast("string"), "bad")
    broken = quality.findings(spark.range(2).where(F.raise_error(F.lit("broke here")).cast("boolean")), "tail_gap", "warn", F.col("id").cast("string"), "never")
    found = verify.run_checks(spark, {"vocabulary": lambda: good, "tail_gap": lambda: broken}).collect()
    assert sorted(r["check"] for r in found) == ["tail_gap", "vocabulary", "vocabulary"]
    (failed,) = [r for r in found if r["severity"] == "error"]
    assert failed["check"] == "tail_gap" and "broke here" in failed["problem"]


def test_pattern_errors(spark):
    bad = quality.pattern_errors(spark.createDataFrame([rule("ok", "x+"), rule("broken", "(x"), rule("class", "[a-")], RULES))
    assert sorted(r["subject"] for r in bad.collect()) == ["broken", "class"]


def test_manual_rules_are_clamped(spark):
    stored = spark.createDataFrame([rule("a", "x", 100, category="tax")], RULES)
    change = spark.createDataFrame([(*rule("a", "y", 1, category="tax"), 1), (*rule("n", "z", 50), 1)], RULES.add("seq", "long"))
    out = rules.upsert_rules(stored, change, manual=True).collect()
    assert [(r["id"], r["pattern"], r["priority"]) for r in out] == [("a", "y", 6)]


def test_read_only_sql(spark):
    assert filters.read_only_sql(spark, "SELECT ? + 1 AS x", [1]).first()["x"] == 2
    assert filters.read_only_sql(spark, " with t as (select 1 as a) select a from t").first()["a"] == 1
    spark.range(1).createOrReplaceTempView("guarded")
    for text in ("DROP VIEW guarded", "WITH t AS (SELECT 1) INSERT INTO guarded SELECT * FROM t", "INSERT INTO guarded SELECT 1", "CREATE TABLE x AS SELECT 1"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            filters.read_only_sql(spark, text)


def test_search_wildcards_and_ranges(spark):
    rows = frame(spark, ledger_row(1, "a", "2026-01-01", "-5", "outflow", text="ab"), ledger_row(2, "a", "2026-01-01", "-5", "outflow", text="A1B"), ledger_row(3, "a", "2026-01-01", "-5", "transfer", text="a1b"))
    hit = rows.where(filters.register_filter(search="a_b"))
    assert [r["id"] for r in hit.collect()] == ["r2"]
    months = spark.createDataFrame([("2025-03",), ("2025-04",), ("2026-01",), ("2026-03",)], "month string")
    shown = lambda kind, **k: {r["month"] for r in months.where(filters.month_range(kind, "2026-03-15", **k)).collect()}
    assert shown("12mo") == {"2025-04", "2026-01", "2026-03"}
    assert shown("ytd") == {"2026-01", "2026-03"}
    assert shown("all") == {"2025-03", "2025-04", "2026-01", "2026-03"}
    accounts = spark.createDataFrame([("a", "I", "N")], "account_id string, institution string, account_name string")
    page = filters.register_page_after(rows, accounts, filters.register_filter(), "2026-01-01", "r2", 5)
    assert [r["id"] for r in page.collect()] == ["r1"]


def test_merchant_texts(spark):
    texts = ["AMAZON #1234", "Amazon  #9987 5555", "SHELL OIL 0042 CT", "ref 123456", "CT", "STORE - ", "x TRACE#12345"]
    got = [r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.normalize_merchant("t").alias("m")).collect()]
    assert got == ["amazon", "amazon", "shell oil", "ref 123456", "ct", "store", "x"]


def test_spend_is_category_driven(spark):
    rows = frame(
        spark, ledger_row(1, "a", "2026-01-01", "-5", "transfer", category="fixed_obligation"), ledger_row(2, "a", "2026-01-01", "2", "inflow", category="medical"),
        ledger_row(3, "a", "2026-01-01", "-9", "transfer", category="transfer"), ledger_row(4, "a", "2026-01-01", "20", "inflow", category="income"),
    )
    out = summaries.monthly_flow(rows).first()
    assert (out["inflow"], out["outflow"], out["net_cash_flow"]) == (20, 5, 15)


def test_debt_floor_and_excess(spark):
    terms = spark.createDataFrame([("h", "l", "Bank", 0.06)], "household_id string, loan string, merchant_match string, annual_rate double")
    money = "decimal(18,2)"
    tiers = spark.createDataFrame([("l", datetime.date(2026, 1, 1), Decimal(1000), Decimal(800), Decimal(200))], f"loan string, effective_from date, scheduled_payment {money}, principal_and_interest {money}, escrow {money}")
    anchors = spark.createDataFrame([("l", datetime.date(2026, 2, 17), Decimal(100000))], f"loan string, statement_date date, balance {money}")
    pay = lambda i, day, amount: ledger_row(i, "a", day, amount, "transfer", category="fixed_obligation", merchant_normalized="Bank")
    rows = frame(spark, pay(1, "2026-03-01", "-950"), pay(2, "2026-03-02", "-1050"), pay(3, "2026-03-03", "-1050.01"), pay(4, "2026-03-04", "-949.99"), pay(5, "2026-01-04", "-1000"))
    out = {str(r["month_start"]): r for r in loans.debt_principal(rows, terms, tiers, anchors).collect()}
    march = out["2026-03-01"]
    assert (march["scheduled_count"], march["debt_paydown_nonscheduled"]) == (3, Decimal("1000.00"))
    # The February statement governs March: 800 less 0.5 % of 100000, three times.
    assert march["mortgage_principal_scheduled"] == Decimal("900.00")
    # January chains backward: two payments earlier the balance was higher.
    balance = (100000 + 800) / 1.005
    balance = (balance + 800) / 1.005
    assert float(out["2026-01-01"]["mortgage_principal_scheduled"]) == round(800 - balance * 0.005, 2)
    bare = loans.paydown_without_terms(rows, "Bank", 1000).where("month_start = '2026-03-01'").first()
    assert (bare["mortgage_principal_scheduled"], bare["debt_paydown_nonscheduled"]) == (0, Decimal("1000.00"))


def test_goal_line(spark):
    day = lambda n: datetime.date(2026, 1, 1) + datetime.timedelta(days=n)
    points = [("up", day(0), 0.0), ("up", day(10), 100.0), ("flat", day(0), 5.0), ("flat", day(9), 5.0), ("done", day(0), 900.0), ("done", day(5), 2000.0), ("one", day(0), 1.0), ("one", day(0), 2.0)]
    targets = spark.createDataFrame([(k, 1000.0) for k in ("up", "flat", "done", "one")], "account_id string, target double")
    out = {r["account_id"]: r["gate_date"] for r in dashboard.goal_line(spark.createDataFrame(points, "account_id string, day date, balance double"), targets).collect()}
    assert out == {"up": day(100), "flat": None, "done": day(5)}


def test_card_balance_is_owed(spark):
    accounts = spark.createDataFrame([("c", "credit_card"), ("s", "savings"), ("n", "checking")], "account_id string, account_type string")
    closing = lambda a: (a, datetime.date(2025, 12, 1), datetime.date(2025, 12, 31), None, Decimal(100), "opening_seed", None, None, None, None, None, None, "")
    stored = spark.createDataFrame([closing("c"), closing("s")], PERIODS)
    rows = frame(spark, *[ledger_row(i, a, "2026-01-05", v, d) for i, (a, v, d) in enumerate([("c", "-30", "outflow"), ("c", "10", "transfer"), ("s", "-30", "outflow"), ("n", "1", "inflow"), ("s", "7", "inflow")])])
    out = {r["account_id"]: r["computed_balance"] for r in balances.computed_balances(rows, accounts, stored, "2026-01-31").collect()}
    assert out == {"c": Decimal("120.00"), "s": Decimal("77.00"), "n": None}


def test_reconcile_keeps_notes_and_repeats(spark):
    accounts = spark.createDataFrame([("s", "savings")], "account_id string, account_type string")
    opening = spark.createDataFrame([("s", Decimal(100))], "account_id string, balance decimal(18,2)")
    marks = spark.createDataFrame([("s", datetime.date(2026, 1, 15), Decimal(95))], "account_id string, as_of date, balance decimal(18,2)")
    rows = frame(spark, ledger_row(1, "s", "2026-01-10", "-10", "outflow"), ledger_row(2, "s", "2026-01-20", "5", "inflow"), ledger_row(3, "s", "2026-02-03", "1", "inflow")).withColumn("running_balance", F.lit(None).cast("decimal(18,2)"))

    def run(stored):
        return balances.reconcile(rows, accounts, opening, marks, stored, start="2026-01-01", end="2026-02-28", as_of="2026-03-01", seed_day="2025-12-31")

    first = run(balances.empty_periods(spark)).orderBy("period_start").collect()
    assert [(str(r["period_end"]), r["statement_opening"], r["computed_closing"], r["variance"]) for r in first] == [
        ("2026-01-15", Decimal(100), Decimal(90), Decimal(5)),
        ("2026-01-31", Decimal(95), Decimal(100), None),
        ("2026-02-28", Decimal(100), Decimal(101), None),
    ]
    whole = ("s", datetime.date(2026, 1, 1), datetime.date(2026, 1, 31), *([None] * 9), "stale full month")
    noted = ("s", datetime.date(2026, 2, 1), datetime.date(2026, 2, 28), *([None] * 9), "my note")
    stored = balances.merge_periods(spark.createDataFrame([whole, noted], PERIODS), run(spark.createDataFrame([whole, noted], PERIODS)))
    kept = {str(r["period_end"]): r["variance_explanation"] for r in stored.collect()}
    assert len(kept) == 3 and kept["2026-02-28"] == "my note" and kept["2026-01-15"].startswith(balances.CHECKPOINT_NOTE)
    again = {str(r["period_end"]): r["variance_explanation"] for r in run(stored).collect()}
    assert again == kept


def test_register_tiers(spark):
    accounts = spark.createDataFrame([("acct-1", "Joint")], "account_id string, account_name string")
    text = lambda i, day, amount, t: ledger_row(i, "acct-1", day, amount, "outflow", text=t)
    rows = frame(spark, text(1, "2026-01-05", "-20", "CHECK# 7"), text(2, "2026-01-06", "-30", "CHECK# 8"), text(3, "2026-01-07", "-30", "check# 9"), text(4, "2026-03-01", "-40", "CHECK# 10 to ACME"))
    entries = [(1, "joint", "7", "2025-06-01", "20", "P"), (2, "JOINT", "99", "2026-01-01", "30", "P"), (3, "acct-1", "10", "2026-02-25", "40", "P"), (4, "nobody", "1", "2026-01-01", "5", "P"), (5, "joint", "5", "2026-01-01", "x", "P"), (6, "joint", "6", "2026-01-01", "1", ""), (7, "joint", "12", "2026-01-01", "1", "P"), (8, "Joint", "12", "2026-01-02", "2", "P")]
    frame_ = spark.createDataFrame(entries, "entry_id int, account string, check_number string, date_written string, amount string, payee string")
    out = {r["entry_id"]: (r["outcome"], r["transaction_id"]) for r in registers.check_register(frame_, accounts, rows).collect()}
    assert out == {
        1: ("matched", "r1"), 2: ("ambiguous_fallback", None), 3: ("matched", "r4"), 4: ("unknown_account", None), 5: ("parse_error", None),
        6: ("missing_value", None), 7: ("duplicate", None), 8: ("duplicate", None),
    }


BENIGN = "id string, check string, account_id string, occurred_on date, period_end date, pattern string, amount decimal(18,2), variance decimal(18,2), expected_count bigint, expected_net decimal(18,2)"


def test_benign_entries_of_any_number(spark):
    """Every combination of what an entry may name, against a loop over all pairs; and fifty thousand of them."""
    import itertools
    import random

    rng = random.Random(4)
    days = [datetime.date(2026, 1, 1 + i) for i in range(3)]
    texts = ["alpha shop", "BETA gym", "gamma"]
    kept = [(i, rng.choice("ab"), rng.choice(days), rng.choice(texts)) for i in range(60)]
    rows = frame(spark, *[ledger_row(i, a, str(day), "-5", "outflow", text=t) for i, a, day, t in kept])
    shapes = list(itertools.product((None, "a", "zz"), (None, days[0]), (None, "shop|gym$", "no such")))
    entries = [(f"e{i:02d}", "orphan_transfers", a, day, None, p, None, None, None, None) for i, (a, day, p) in enumerate(shapes)]
    judged = {r["id"]: r["matched"] for r in quality.benign_transactions(rows, rows, spark.createDataFrame(entries, BENIGN), "orphan_transfers").collect()}
    for i, (a, day, p) in enumerate(shapes):
        about = [k for k in kept if a in (None, k[1]) and day in (None, k[2]) and (p is None or (p == "shop|gym$" and k[3] != "gamma"))]
        assert judged[f"e{i:02d}"] == len(about), shapes[i]
    many = spark.range(50_000).select(
        F.format_string("m%05d", "id").alias("id"), F.lit("orphan_transfers").alias("check"), F.when(F.col("id") > 1, F.format_string("other%d", "id")).otherwise("a").alias("account_id"),
        F.lit(None).cast("date").alias("occurred_on"), F.lit(None).cast("date").alias("period_end"), F.lit("alpha").alias("pattern"), *[F.lit(None).cast("decimal(18,2)").alias(c) for c in ("amount", "variance")],
        F.lit(None).cast("bigint").alias("expected_count"), F.lit(None).cast("decimal(18,2)").alias("expected_net"),
    )
    found = quality.benign_transactions(rows, rows, many, "orphan_transfers")
    left, explained = quality.suppress_transactions(rows, found, many)
    alphas = {f"r{k[0]}" for k in kept if k[1] == "a" and k[3].startswith("alpha")}
    assert {r["id"]: r["suppressed_by"] for r in explained.collect()} == dict.fromkeys(alphas, "m00000")
    assert left.count() == 60 - len(alphas)


def test_benign_periods(spark):
    end, later = datetime.date(2026, 1, 31), datetime.date(2026, 2, 28)
    found = spark.createDataFrame([("a", end, "k", "p", Decimal(1)), ("a", later, "k", "p", None), ("b", end, "k", "p", Decimal(2))], "account_id string, period_end date, kind string, problem string, variance decimal(18,2)")
    entries = [("x", "stored_reconciliation", "a", None, end, None, None, Decimal(1), None, None), ("y", "stored_reconciliation", None, None, end, None, None, Decimal(1), None, None), ("z", "stored_reconciliation", None, None, None, None, None, None, 3, None)]
    benign = spark.createDataFrame(entries, BENIGN)
    judged = quality.benign_periods(found, benign, "stored_reconciliation")
    assert {r["id"]: (r["matched"], r["falsified"]) for r in judged.collect()} == {"x": (1, ""), "y": (2, "variance"), "z": (3, "applies to rows only")}
    left = quality.suppress_periods(found, judged, benign).collect()
    assert {(r["account_id"], r["period_end"].month) for r in left} == {("a", 2), ("b", 1)}


def test_rules_of_one_pattern_are_filed_once(spark):
    """Thousands of rules of few patterns meet a row as few, and each filter keeps its first rule."""
    from tallyframe.operators import rule_index

    book = [
        rule(f"r{i:04d}", ("amazon", "whole foods", ".+")[i % 3], priority=50 - i // 100, direction=(None, "inflow", "", "outflow")[i % 4], account=(None, "a", "b", "")[i // 4 % 4], category=None if i % 10 == 9 else f"c{i}")
        for i in range(1_800)
    ]
    table = spark.createDataFrame(book, RULES)
    firsts = rule_index.one_per_filter(table)
    none = spark.createDataFrame([], "key string, rows long")
    assert rule_index.filed(firsts, none).count() == 2 + rule_index.SALTS
    rows = frame(spark, *[ledger_row(i, "abc"[i % 3], "2026-01-01", "-5", ("inflow", "outflow", "transfer")[i // 3 % 3], text=("AMAZON", "whole foods amazon", "x")[i // 9]) for i in range(27)])
    short = {r["id"]: r["match"] for r in rules.match_rules(rows, rules.load_rules(table)).collect()}
    assert {r["id"]: r["match"] for r in rules.match_rules(rows, table).collect()} == short

"""Dashboard figures: totals, subscriptions, leakage, trends, goal line, feasibility, audits, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.operators.common import HOUSEHOLD, as_day

SUBSCRIPTION_ROWS = 24
AUDIT_WINDOW_DAYS = 183
AUDIT_ROWS = 100


def mean(total: Column, count: Column) -> Column:
    """``total / count`` to the cent, half up, divided as decimals."""
    return F.round(total / count, 2).cast("double")


def kpis(months: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Totals and averages over the months shown."""
    return months.groupBy(*scope).agg(
        F.count("*").alias("month_count"),
        F.sum("inflow").alias("total_inflow"),
        F.sum("outflow").alias("total_outflow"),
        (F.sum("inflow") - F.sum("outflow")).alias("net"),
        mean(F.sum("inflow"), F.count("*")).alias("avg_inflow"),
        mean(F.sum("outflow"), F.count("*")).alias("avg_outflow"),
    )


def trailing_change(months: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Last three months against the three before when there are six, else against the prior month."""
    newest = Window.partitionBy(*scope).orderBy(F.col("month").desc())
    ranked = months.withColumn("_rn", F.row_number().over(newest)).where("_rn <= 6")

    def part(low: int, high: int, name: str) -> Column:
        return F.sum(F.when(F.col("_rn").between(low, high), F.col(name)))

    aggregates = [F.count("*").alias("n")]
    for name in ("inflow", "outflow"):
        aggregates += [
            part(1, 3, name).alias(f"{name}_recent3"), part(4, 6, name).alias(f"{name}_prior3"),
            part(1, 1, name).alias(f"{name}_last"), part(2, 2, name).alias(f"{name}_prev"),
        ]
    sums = ranked.groupBy(*scope).agg(*aggregates)

    def change(name: str) -> Column:
        now = F.when(F.col("n") >= 6, F.col(f"{name}_recent3")).otherwise(F.col(f"{name}_last")).cast("double")
        before = F.when(F.col("n") >= 6, F.col(f"{name}_prior3")).otherwise(F.col(f"{name}_prev")).cast("double")
        return F.when((F.col("n") >= 2) & (before != 0), F.round((now - before) / before, 6)).alias(f"{name}_change")

    label = F.when(F.col("n") >= 6, "trailing 3 months").when(F.col("n") >= 2, "prior month")
    return sums.select(*scope, change("inflow"), change("outflow"), label.alias("basis"))


def subscription_audit(ledger: DataFrame, scope: Sequence[str] = HOUSEHOLD, limit: int = SUBSCRIPTION_ROWS) -> DataFrame:
    """Recurring app and streaming charges per merchant, highest monthly burn first."""
    charges = ledger.where(
        (F.col("direction") == "outflow")
        & (F.col("primary_category") == "fixed_obligation")
        & F.col("subcategory").isin(*P.SUBSCRIPTION_SUBCATEGORIES)
    )
    grouped = charges.groupBy(
        *scope, S.vendor().alias("merchant"), "subcategory", F.nullif("household_role", F.lit("")).alias("household_role")
    ).agg(
        F.count("*").alias("charge_count"),
        F.count_distinct(S.month_label("occurred_on")).alias("month_count"),
        F.sum(F.abs("amount")).alias("total_amount"),
        F.max("occurred_on").alias("last_charged_on"),
    )
    total = F.col("total_amount")
    measured = grouped.withColumn("avg_amount", mean(total, F.col("charge_count"))).withColumn(
        "monthly_burn", mean(total, F.col("month_count"))
    )
    ranked = Window.partitionBy(*scope).orderBy(
        F.col("monthly_burn").desc(), "merchant", "subcategory", F.col("household_role").asc_nulls_first()
    )
    return measured.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= limit)


def leakage_burn(ledger: DataFrame, caps: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Average monthly outflow per capped category (months with spend), against its cap.

    ``caps`` carries the scope columns, ``category_key``, ``name`` and ``monthly_cap``.
    """
    monthly = (
        ledger.where(F.col("direction") == "outflow")
        .groupBy(*scope, "primary_category", S.month_label("occurred_on").alias("m"))
        .agg(F.sum(F.abs("amount")).alias("total"))
    )
    average = mean(F.sum("total"), F.count("*"))
    burn = monthly.groupBy(*scope, F.col("primary_category").alias("category_key")).agg(average.alias("monthly_burn"))
    cap = F.coalesce(F.col("monthly_cap").cast("double"), F.lit(0.0))
    return (
        caps.join(burn, [*scope, "category_key"], "left")
        .withColumn("monthly_burn", F.coalesce("monthly_burn", F.lit(0.0)))
        .withColumn("monthly_cap", cap)
        .withColumn("over_by", F.round(F.col("monthly_burn") - F.col("monthly_cap"), 2))
        .withColumn("ratio", F.when(F.col("monthly_cap") == 0, 0.0).otherwise(F.round(F.col("monthly_burn") / F.col("monthly_cap"), 6)))
        .withColumn("is_over", F.col("ratio") > 1)
    )


def goal_line(points: DataFrame, targets: DataFrame, keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """Least-squares line of balance on days per account, and the day it crosses the target.

    Fewer than two distinct days give no line; a flat or falling line no date; a reached
    target the last day.
    """
    first = points.groupBy(*keys).agg(
        F.min("day").alias("first_day"),
        F.max(F.struct("day", "balance")).alias("last"),
        F.count_distinct("day").alias("days"),
    )
    x = F.datediff("day", "first_day").cast("double")
    y = F.col("balance").cast("double")
    fitted = (
        points.join(first, list(keys))
        .groupBy(*keys, "first_day", "last", "days")
        .agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
        .where("days >= 2")
        .join(targets.select(*keys, F.col("target").cast("double").alias("target")), list(keys))
    )
    crossing = F.date_add("first_day", F.floor((F.col("target") - F.col("intercept")) / F.col("slope")).cast("int"))
    reached = F.col("last.balance").cast("double") >= F.col("target")
    return fitted.select(
        *keys,
        F.round("slope", 4).alias("daily_rate"),
        F.when(F.col("slope") <= 0, F.lit(None).cast("date"))
        .when(reached, F.col("last.day"))
        .otherwise(crossing)
        .alias("gate_date"),
        "target",
    )


def feasibility(months: DataFrame, goal: DataFrame, leakage: DataFrame, as_of: date | str, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Three drivers (net flow, goal date, leakage) and the worst of them per household.

    ``goal`` carries the scope and ``gate_date`` (no row: no line; null date: not reachable).
    """
    net = months.groupBy(*scope).agg(
        mean(F.sum("inflow") - F.sum("outflow"), F.count("*")).alias("avg_net")
    )
    over = leakage.groupBy(*scope).agg(F.round(F.sum(F.greatest(F.col("over_by"), F.lit(0.0))), 2).alias("total_overage"))
    line = goal.select(*scope, "gate_date", F.lit(True).alias("_has_line"))
    months_out = F.datediff("gate_date", as_day(as_of)) / 30.44
    joined = net.join(line, list(scope), "full_outer").join(over, list(scope), "full_outer")
    flow = (
        F.when(F.col("avg_net").isNull(), "unknown").when(F.col("avg_net") < 0, "red").when(F.col("avg_net") < 1500, "yellow").otherwise("green")
    )
    date_driver = (
        F.when(F.col("_has_line").isNull(), "unknown")
        .when(F.col("gate_date").isNull(), "red")
        .when(months_out <= 24, "green")
        .when(months_out <= 48, "yellow")
        .otherwise("red")
    )
    leak = (
        F.when(F.col("total_overage").isNull(), "unknown")
        .when(F.col("total_overage") > 1000, "red")
        .when(F.col("total_overage") > 300, "yellow")
        .otherwise("green")
    )

    def rank(status: Column) -> Column:
        return F.when(status == "red", 3).when(status == "yellow", 2).when(status == "green", 1).otherwise(0)

    worst = F.greatest(rank(flow), rank(date_driver), rank(leak))
    names = F.when(worst == 3, "red").when(worst == 2, "yellow").when(worst == 1, "green").otherwise("unknown")
    return joined.select(
        *scope, "avg_net", "gate_date", "total_overage", flow.alias("net_flow_status"), date_driver.alias("goal_status"),
        leak.alias("leakage_status"), names.alias("status"),
    )


def merchant_frequency(ledger: DataFrame, as_of: date | str, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Rows per vendor, over all time and over the trailing half year."""
    recent = F.col("occurred_on") >= F.date_sub(as_day(as_of), AUDIT_WINDOW_DAYS)
    return ledger.groupBy(*scope, S.vendor().alias("vendor")).agg(
        F.count("*").alias("occurrences"), F.count_if(recent).alias("recent_occurrences")
    )


def with_merchant_frequency(ledger: DataFrame, as_of: date | str, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Each row with its vendor's counts: counts are aggregated first, so a popular vendor is one joined row."""
    rows = ledger.withColumn("vendor", S.vendor())
    return rows.join(merchant_frequency(ledger, as_of, scope), [*scope, "vendor"])


def lifecycle_audit(
    ledger: DataFrame,
    as_of: date | str,
    *,
    min_amount: float = 0,
    category: str | None = None,
    limit: int = AUDIT_ROWS,
    scope: Sequence[str] = HOUSEHOLD,
) -> DataFrame:
    """Rows whose lifecycle label looks wrong, first reason wins, largest amounts first.

    Merchant counts are over all rows; ``category`` restricts only the candidates.
    """
    rows = with_merchant_frequency(ledger, as_of, scope)
    size = F.abs("amount")
    once, recurring = F.col("lifecycle") == "one_time", F.col("lifecycle") == "recurring"
    reason = (
        F.when((F.col("subcategory") == "pet_care") & (size > 500), "pet_care_high_value")
        .when((F.col("primary_category") == "variable_lifestyle") & once & (size > 500), "discretionary_outlier_one_time")
        .when(once & (F.col("recent_occurrences") >= 3) & (size >= min_amount), "one_time_but_recurring_merchant")
        .when(recurring & (F.col("occurrences") == 1) & (size >= min_amount), "recurring_but_single_occurrence")
    )
    found = rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
    if category:
        found = found.where(F.col("primary_category") == category)
    totals = found.groupBy(*scope).agg(F.count("*").alias("total"))
    ranked = Window.partitionBy(*scope).orderBy(size.desc(), "id")
    few = found.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= max(1, limit))
    return few.join(totals, list(scope)).select(
        *scope, "id", "occurred_on", "vendor", "amount", "primary_category", "subcategory", "lifecycle", "reason", "position", "total"
    )


def account_metrics(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows and first and last day per account; accounts without rows count zero."""
    counts = ledger.groupBy("account_id").agg(
        F.count("*").alias("row_count"), F.min("occurred_on").alias("first_on"), F.max("occurred_on").alias("last_on")
    )
    return accounts.select("account_id", "institution", "account_type").join(counts, "account_id", "full_outer").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0)).cast("bigint")
    )


def category_metrics(ledger: DataFrame, as_of_year: int, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    return ledger.groupBy(*scope, "primary_category").agg(
        F.count("*").alias("all_time"), F.count_if(F.year("occurred_on") == as_of_year).alias("in_year")
    )


def rule_band_metrics(rules: DataFrame) -> DataFrame:
    band = F.when(F.col("priority") < 5, "below_5").when(F.col("priority") == 5, "5").when(F.col("priority") <= 9, "6-9").otherwise("10+")
    return rules.groupBy(band.alias("band")).agg(F.count("*").alias("rules"))


def override_metrics(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Stored overrides, rows they govern, rows stamped: one row."""
    from tallyframe.operators.overrides import governed_rows

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")

    return (
        one(overrides, "overrides")
        .unionByName(one(governed_rows(ledger, overrides), "rows_matching"))
        .unionByName(one(ledger.where(S.is_flagged()), "rows_stamped"))
    )


def source_counts(ledger: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    return ledger.groupBy(*scope, "source_document_name").agg(F.count("*").alias("row_count"))

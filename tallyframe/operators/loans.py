"""Debt principal carve-out: payment tiers, balance anchors and amortisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.operators.common import HOUSEHOLD, join_interval, mark_intervals
from tallyframe.session import cut_lineage

# Fixed value: a payment this close to the scheduled one is the scheduled one.
MATCH_TOLERANCE = 50


def with_tier(rows: DataFrame, tiers: DataFrame, day: str) -> DataFrame:
    """The payment tier in effect on each row's ``day``: the latest started, else the first."""
    columns = tiers.select("loan", "effective_from", "scheduled_payment", "principal_and_interest", "escrow")
    return join_interval(rows, mark_intervals(columns, ["loan"], "effective_from"), ["loan"], day)


def with_anchor(rows: DataFrame, anchors: DataFrame, month: str) -> DataFrame:
    """The balance anchor of each row's month: the latest anchor month on or before it, else the earliest.

    A statement dated in month M governs the payment of month M+1.
    """
    governs = S.next_month_start("statement_date")
    marks = anchors.select("loan", governs.alias("anchor_month"), "balance", governs.alias("_governs"))
    return join_interval(rows, mark_intervals(marks, ["loan"], "_governs"), ["loan"], month)


def amortized_principal(loans: DataFrame, tiers: DataFrame, anchors: DataFrame, months: DataFrame) -> DataFrame:
    """Principal part of the scheduled payment for every loan and month of ``months(loan, month_start)``.

    With monthly rate r, payments P and a balance known at month a, the balance at month
    T, later or earlier, is ``(1+r)^T * (B_a (1+r)^-a - (S(T) - S(a)))`` where ``S`` is the
    running sum of ``P_i (1+r)^-(i+1)``. One window over the months serves both directions.
    """
    ends = (
        months.select("loan", "month_start")
        .unionByName(anchors.select("loan", S.next_month_start("statement_date").alias("month_start")))
        .groupBy("loan")
        .agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi"))
    )
    grid = ends.select("loan", "lo", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month_start"))
    grid = with_tier(grid, tiers, "month_start").join(loans.select("loan", (F.col("annual_rate") / 12).alias("r")), "loan")
    step = (S.month_index("month_start") - S.month_index("lo")).cast("double")
    growth = F.lit(1.0) + F.col("r")
    before = Window.partitionBy("loan").orderBy("month_start").rowsBetween(Window.unboundedPreceding, -1)
    paid = F.col("principal_and_interest").cast("double") * F.pow(growth, -(F.col("step") + 1))
    grid = (
        grid.withColumn("step", step)
        .withColumn("discounted", F.coalesce(F.sum(paid).over(before), F.lit(0.0)))
        .withColumn("factor", F.pow(growth, F.col("step")))
    )
    anchored = with_anchor(months.select("loan", "month_start"), anchors, "month_start")
    at_anchor = grid.select(
        "loan", F.col("month_start").alias("anchor_month"), F.col("discounted").alias("anchor_discounted"),
        F.col("factor").alias("anchor_factor"),
    )
    balance = F.col("factor") * (
        F.col("balance").cast("double") / F.col("anchor_factor") - (F.col("discounted") - F.col("anchor_discounted"))
    )
    return (
        anchored.join(at_anchor, ["loan", "anchor_month"])
        .join(grid, ["loan", "month_start"])
        .select(
            "loan",
            "month_start",
            F.round(F.col("principal_and_interest").cast("double") - balance * F.col("r"), 2)
            .cast("decimal(18,2)")
            .alias("principal"),
        )
    )


def loan_rows(ledger: DataFrame, loans: DataFrame) -> DataFrame:
    """Ledger rows that pay a loan: its merchant, fixed obligation, not an inflow."""
    match = loans.select(*HOUSEHOLD, "loan", F.col("merchant_match").alias("merchant_normalized"))
    return ledger.where(P.is_fixed_obligation()).join(match, [*HOUSEHOLD, "merchant_normalized"])


def debt_principal(
    ledger: DataFrame, loans: DataFrame, tiers: DataFrame, anchors: DataFrame, tolerance: float = MATCH_TOLERANCE
) -> DataFrame:
    """Scheduled and non-scheduled debt paydown per household and month.

    A row at or above its scheduled payment less the tolerance is one scheduled payment,
    and its excess counts when it exceeds the tolerance; a smaller row is all paydown. The
    ledger is read once: its sums, one row per loan and month, are settled before the
    schedule takes its months from them.
    """
    rows = with_tier(loan_rows(ledger, loans), tiers, "occurred_on")
    paid = F.abs("amount")
    excess = paid - F.col("scheduled_payment")
    scheduled = excess >= -tolerance
    extra = F.when(~scheduled, paid).when(excess > tolerance, excess).otherwise(F.lit(0).cast("decimal(18,2)"))
    monthly = rows.groupBy(*HOUSEHOLD, "loan", F.trunc("occurred_on", "month").alias("month_start")).agg(
        F.count_if(scheduled).alias("scheduled_count"), F.sum(extra).alias("debt_paydown_nonscheduled")
    )
    monthly = cut_lineage(monthly)
    principal = amortized_principal(loans, tiers, anchors, monthly)
    return (
        monthly.join(principal, ["loan", "month_start"], "left")
        .groupBy(*HOUSEHOLD, "month_start")
        .agg(
            F.sum("scheduled_count").alias("scheduled_count"),
            F.sum(F.coalesce(F.col("principal"), F.lit(0)) * F.col("scheduled_count")).cast("decimal(28,2)").alias(
                "mortgage_principal_scheduled"
            ),
            F.sum("debt_paydown_nonscheduled").cast("decimal(28,2)").alias("debt_paydown_nonscheduled"),
        )
        .withColumn(
            "mortgage_principal",
            (F.col("mortgage_principal_scheduled") + F.col("debt_paydown_nonscheduled")).cast("decimal(28,2)"),
        )
    )


def paydown_without_terms(ledger: DataFrame, merchant: str, scheduled_payment: float, tolerance: float = MATCH_TOLERANCE) -> DataFrame:
    """The carve-out when a household has no loan terms: no scheduled principal, same floor and excess rule."""
    paid = F.abs("amount")
    excess = paid - F.lit(str(scheduled_payment)).cast("decimal(18,2)")
    extra = F.when(excess < -tolerance, paid).when(excess > tolerance, excess).otherwise(F.lit(0).cast("decimal(18,2)"))
    zero = F.lit(0).cast("decimal(28,2)")
    return (
        ledger.where(P.is_fixed_obligation() & (F.col("merchant_normalized") == merchant))
        .groupBy(*HOUSEHOLD, F.trunc("occurred_on", "month").alias("month_start"))
        .agg(
            F.count_if(excess >= -tolerance).alias("scheduled_count"),
            F.sum(extra).cast("decimal(28,2)").alias("debt_paydown_nonscheduled"),
        )
        .withColumn("mortgage_principal_scheduled", zero)
        .withColumn("mortgage_principal", F.col("debt_paydown_nonscheduled"))
    )

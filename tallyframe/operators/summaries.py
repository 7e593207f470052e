"""Monthly and annual cash-flow summaries.

Every scalar of every month comes from one conditional aggregation per
(household, month); everything after that is a window over the month spine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.operators.common import HOUSEHOLD, as_day, month_spine

def zero() -> Column:
    return F.lit(0).cast("decimal(28,2)")


# A merchant moves when it had a base and changed enough, or is new and large.
MOVER_PRIOR_BASE = 100
MOVER_CHANGE = 200
MOVER_NEW = 300

MEASURES = (
    "inflows",
    "fixed_obligations",
    "discretionary",
    "income_offsets",
    "spend_offsets",
    "pay_deposits",
    "investment_outflows",
)
CONSUMPTION_FIELDS = (
    "earned_income",
    "reimbursements",
    "reimbursements_income_side",
    "reimbursements_spend_side",
    "mortgage_principal",
    "mortgage_principal_scheduled",
    "debt_paydown_nonscheduled",
    "net_consumption",
)


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part.cast("double") / whole.cast("double") * 100, 2)


def _annualized(to_date: Column) -> Column:
    """Year to date scaled to twelve months; divided as decimals so half cents round up."""
    return F.round(to_date * 12 / F.month("month_start"), 2).cast("double")


def monthly_flow(ledger: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Income, spend and net per month, decided by category; net is rounded once."""
    magnitude = F.abs("amount")
    inflow, outflow = P.sum_where(P.is_income()), P.sum_where(P.is_spend(), magnitude)
    return ledger.groupBy(*scope, S.month_label("occurred_on").alias("month")).agg(
        inflow.alias("inflow"), outflow.alias("outflow"), (inflow - outflow).alias("net_cash_flow")
    )


def month_measures(ledger: DataFrame, scope: Sequence[str] = HOUSEHOLD, *extra: Column) -> DataFrame:
    """All ledger-wide scalars of a month in one pass, plus any ``extra`` aggregates."""
    magnitude = F.abs("amount")
    return ledger.groupBy(*scope, F.trunc("occurred_on", "month").alias("month_start")).agg(
        F.count("*").alias("row_count"),
        P.sum_where(P.is_income()).alias("inflows"),
        P.sum_where(P.is_fixed_obligation(), magnitude).alias("fixed_obligations"),
        P.sum_where(P.is_discretionary(), magnitude).alias("discretionary"),
        P.sum_where(P.is_income_offset(), magnitude).alias("income_offsets"),
        P.sum_where(P.is_spend_offset(), magnitude).alias("spend_offsets"),
        P.sum_where(P.is_pay_deposit()).alias("pay_deposits"),
        P.sum_where(P.is_investment(), magnitude).alias("investment_outflows"),
        *extra,
    )


def consumption_split(measures: DataFrame) -> DataFrame:
    """Earned income and reimbursements from the month measures."""
    return measures.select(
        "*",
        (F.col("inflows") - F.col("income_offsets")).alias("earned_income"),
        (F.col("income_offsets") + F.col("spend_offsets")).alias("reimbursements"),
        F.col("income_offsets").alias("reimbursements_income_side"),
        F.col("spend_offsets").alias("reimbursements_spend_side"),
    )


def account_month_delta(ledger: DataFrame, keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """Net change per account and month over all categories."""
    return ledger.groupBy(*keys, F.trunc("occurred_on", "month").alias("month_start")).agg(
        F.sum("amount").alias("monthly_delta")
    )


def trailing_average(deltas: DataFrame, keys: Sequence[str] = ("account_id",), value: str = "monthly_delta") -> DataFrame:
    """Three-month trailing average on a dense month spine; a missing month counts as zero."""
    spine = month_spine(deltas, keys, "month_start")
    dense = spine.join(deltas, [*keys, "month_start"], "left").withColumn(value, F.coalesce(value, zero()))
    last3 = Window.partitionBy(*keys).orderBy("month_start").rowsBetween(-2, 0)
    return dense.withColumn("trailing_3mo_avg", F.round(F.sum(value).over(last3).cast("double") / 3, 2))


def month_over_month(measures: DataFrame, keys: Sequence[str] = HOUSEHOLD, value: str = "discretionary") -> DataFrame:
    """Prior month, change, percent change, year to date and annualised figure of ``value``."""
    spine = month_spine(measures, keys, "month_start")
    dense = spine.join(measures.select(*keys, "month_start", value), [*keys, "month_start"], "left")
    dense = dense.withColumn(value, F.coalesce(value, zero()))
    in_order = Window.partitionBy(*keys).orderBy("month_start")
    year_to_date = (
        Window.partitionBy(*keys, F.year("month_start")).orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    )
    prior = F.coalesce(F.lag(value).over(in_order), zero())
    return (
        dense.withColumn("prior_month", prior)
        .withColumn("mom_delta", F.col(value) - F.col("prior_month"))
        .withColumn(
            "mom_delta_pct",
            F.when(F.col("prior_month") > 0, _percent(F.col("mom_delta"), F.col("prior_month"))).otherwise(F.lit(0.0)),
        )
        .withColumn("ytd", F.sum(value).over(year_to_date))
        .withColumn("ytd_annualized", _annualized(F.col("ytd")))
    )


def merchant_totals(ledger: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Discretionary spend per merchant key and month, with a display name."""
    return (
        ledger.where(P.is_discretionary())
        .groupBy(*scope, F.trunc("occurred_on", "month").alias("month_start"), S.merchant_key().alias("merchant_key"))
        .agg(F.sum(F.abs("amount")).alias("total"), F.min(S.merchant_name()).alias("merchant_name"))
    )


def top_movers(totals: DataFrame, scope: Sequence[str] = HOUSEHOLD, limit: int = 3) -> DataFrame:
    """Largest merchant changes against the prior month, ``limit`` per month.

    Each total counts once as its own month and once as the next month's prior, so the
    two months meet in one aggregation instead of a full outer join.
    """
    last = totals.groupBy(*scope).agg(F.max("month_start").alias("last_month"))
    this = totals.select(
        *scope, "month_start", "merchant_key", F.col("total").alias("this_total"), zero().alias("prior_total"),
        F.col("merchant_name").alias("this_name"), F.lit(None).cast("string").alias("prior_name"),
    )
    prior = totals.select(
        *scope, F.add_months("month_start", 1).alias("month_start"), "merchant_key", zero().alias("this_total"),
        F.col("total").alias("prior_total"), F.lit(None).cast("string").alias("this_name"),
        F.col("merchant_name").alias("prior_name"),
    )
    both = (
        this.unionByName(prior)
        .groupBy(*scope, "month_start", "merchant_key")
        .agg(
            F.sum("this_total").alias("this_month"),
            F.sum("prior_total").alias("prior_month"),
            F.coalesce(F.max("this_name"), F.max("prior_name")).alias("merchant"),
        )
        .withColumn("delta", F.col("this_month") - F.col("prior_month"))
        .withColumn("is_new", F.col("prior_month") <= 0)
    )
    moved = F.when(F.col("is_new"), F.col("this_month") >= MOVER_NEW).otherwise(
        (F.col("prior_month") >= MOVER_PRIOR_BASE) & (F.abs("delta") >= MOVER_CHANGE)
    )
    ranked = Window.partitionBy(*scope, "month_start").orderBy(
        F.abs("delta").desc(), F.col("this_month").desc(), F.col("merchant_key")
    )
    return (
        both.join(last, list(scope))
        .where(moved & (F.col("month_start") <= F.col("last_month")))
        .withColumn("position", F.row_number().over(ranked))
        .where(F.col("position") <= limit)
        .drop("last_month")
    )


def goal_projection(df: DataFrame, balance: Column, target: Column, average: Column, month: Column) -> DataFrame:
    """Months to the goal at the trailing average, and the end of the month it is reached."""
    gap = target.cast("double") - balance.cast("double")
    months = F.ceil(gap / average).cast("int")
    return (
        df.withColumn("gap", F.round(gap, 2))
        .withColumn(
            "projection_status",
            F.when(F.col("gap") <= 0, "reached").when(average <= 0, "indefinite").otherwise("projected"),
        )
        .withColumn(
            "months_remaining",
            F.when(F.col("projection_status") == "reached", F.lit(0))
            .when(F.col("projection_status") == "projected", months)
            .cast("int"),
        )
        .withColumn("projected_hit_date", F.last_day(F.add_months(month, F.col("months_remaining"))))
    )


def savings_view(df: DataFrame) -> DataFrame:
    """Implied withholding (floored at zero), theoretical savings and rates from a joined parameter row."""
    gross = F.col("gross_monthly")
    advantaged = F.col("retirement_a") + F.col("retirement_b") + F.col("hsa")
    implied = gross - advantaged - F.col("pay_deposits")
    saved = advantaged + F.col("monthly_delta") + F.col("investment_outflows")
    rate = F.when(gross > 0, _percent(saved, gross)).otherwise(F.lit(0.0))
    return (
        df.withColumn("tax_advantaged", advantaged)
        .withColumn("implied_withholding", F.greatest(implied, zero()))
        .withColumn("withholding_floored", implied < 0)
        .withColumn("theoretical_savings", saved)
        .withColumn("theoretical_rate_pct", rate)
        .withColumn("delta_vs_target_pct", F.round(rate - F.col("savings_rate_target_pct").cast("double"), 2))
        .withColumn("params_incomplete", (F.col("retirement_a") == 0) | (F.col("retirement_b") == 0))
    )


def monthly_summary(
    ledger: DataFrame,
    goal_accounts: DataFrame,
    goal_balances: DataFrame,
    params: DataFrame,
    debt: DataFrame,
) -> DataFrame:
    """Every section of every month of every household.

    ``goal_accounts(household_id, account_id)``, ``goal_balances(account_id, computed_balance)``,
    ``params`` one row per household, ``debt(household_id, month_start, mortgage_principal,
    mortgage_principal_scheduled, debt_paydown_nonscheduled)``.
    """
    keys = [*HOUSEHOLD, "month_start"]
    marked = ledger.join(goal_accounts.withColumn("_goal", F.lit(True)), [*HOUSEHOLD, "account_id"], "left")
    measures = month_measures(marked, HOUSEHOLD, P.sum_where(F.col("_goal")).alias("monthly_delta"))
    spine = month_spine(measures, HOUSEHOLD, "month_start")
    balances = goal_accounts.join(goal_balances, "account_id", "left").groupBy(*HOUSEHOLD).agg(
        F.coalesce(F.sum("computed_balance"), zero()).alias("goal_balance")
    )
    money = [*MEASURES, "monthly_delta", "mortgage_principal", "mortgage_principal_scheduled", "debt_paydown_nonscheduled"]
    dense = (
        spine.join(measures, keys, "left").join(debt, keys, "left")
        .select(*keys, F.coalesce("row_count", F.lit(0)).alias("row_count"), *[F.coalesce(m, zero()).alias(m) for m in money])
        .join(params, list(HOUSEHOLD))
        .join(balances, list(HOUSEHOLD), "left")
        .withColumn("goal_balance", F.coalesce("goal_balance", zero()))
    )
    in_order = Window.partitionBy(*HOUSEHOLD).orderBy("month_start")
    to_date = Window.partitionBy(*HOUSEHOLD, F.year("month_start")).orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        consumption_split(dense)
        .withColumn("trailing_3mo_avg", F.round(F.sum("monthly_delta").over(in_order.rowsBetween(-2, 0)).cast("double") / 3, 2))
        .withColumn("net_fcf", F.col("inflows") - F.col("fixed_obligations") - F.col("discretionary"))
        .withColumn(
            "savings_rate_pct",
            F.when(F.col("inflows") > 0, _percent(F.col("monthly_delta"), F.col("inflows"))).otherwise(F.lit(0.0)),
        )
        .withColumn(
            "net_consumption",
            F.col("fixed_obligations") + F.col("discretionary") - F.col("reimbursements") - F.col("mortgage_principal"),
        )
        .withColumn("prior_discretionary", F.coalesce(F.lag("discretionary").over(in_order), zero()))
        .withColumn("mom_delta", F.col("discretionary") - F.col("prior_discretionary"))
        .withColumn(
            "mom_delta_pct",
            F.when(F.col("prior_discretionary") > 0, _percent(F.col("mom_delta"), F.col("prior_discretionary"))).otherwise(
                F.lit(0.0)
            ),
        )
        .withColumn("ytd_discretionary", F.sum("discretionary").over(to_date))
        .withColumn("ytd_annualized", _annualized(F.col("ytd_discretionary")))
    )
    out = savings_view(out)
    return goal_projection(out, F.col("goal_balance"), F.col("goal_target"), F.col("trailing_3mo_avg"), F.col("month_start"))


def summary_flags(summary: DataFrame, ledger: DataFrame) -> DataFrame:
    """Review flags as rows: rate below floor, spend above ceiling, negative withholding, abnormal rows.

    ``summary`` carries the parameter columns; ``ledger`` supplies the abnormal rows.
    """
    keys = [*HOUSEHOLD, "month_start"]

    def flag(condition: Column, code: str, severity: str, value: Column) -> Column:
        return F.when(
            condition,
            F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), value.cast("double").alias("value")),
        )

    monthly = F.array_compact(
        F.array(
            flag(
                F.col("savings_rate_pct") < F.col("savings_rate_floor_pct"),
                "savings_rate_below_floor", "warn", F.col("savings_rate_pct"),
            ),
            flag(
                F.col("discretionary") > F.col("discretionary_ceiling"),
                "discretionary_over_ceiling", "warn", F.col("discretionary"),
            ),
            flag(
                F.col("withholding_floored"), "implied_withholding_negative", "warn",
                F.col("gross_monthly") - F.col("tax_advantaged") - F.col("pay_deposits"),
            ),
        )
    )
    raised = summary.select(*keys, F.explode(monthly).alias("f")).select(
        *keys, "f.code", "f.severity", F.lit(None).cast("string").alias("merchant"),
        F.lit(None).cast("date").alias("occurred_on"), "f.value",
    )
    limits = summary.select(*HOUSEHOLD, "abnormal_threshold").distinct()
    abnormal = (
        ledger.where(F.col("primary_category") == "abnormal")
        .join(limits, list(HOUSEHOLD))
        .where(F.abs("amount") > F.col("abnormal_threshold"))
        .select(
            *HOUSEHOLD, F.trunc("occurred_on", "month").alias("month_start"), F.lit("abnormal_outflow").alias("code"),
            F.lit("alert").alias("severity"), S.merchant_name().alias("merchant"), "occurred_on",
            F.abs("amount").cast("double").alias("value"),
        )
    )
    return raised.unionByName(abnormal)


def identity_check(summary: DataFrame) -> DataFrame:
    """earned - consumption = net + principal + spend-side refunds, to the cent."""
    left = F.col("earned_income") - F.col("net_consumption")
    right = F.col("net_fcf") + F.col("mortgage_principal") + F.col("reimbursements_spend_side")
    return summary.select(*HOUSEHOLD, "month_start", (left - right).alias("residual"), (left == right).alias("holds"))


def annual_summary(summary: DataFrame) -> DataFrame:
    """Month rows plus one total row per year: a rollup over the monthly summary of months with rows."""
    fields = ["inflows", "fixed_obligations", "discretionary", "net_fcf", *CONSUMPTION_FIELDS]
    present = summary.where("row_count > 0").select(
        *HOUSEHOLD, F.year("month_start").alias("year"), S.month_label("month_start").alias("month"), *fields
    )
    rolled = present.rollup("household_id", "year", "month").agg(*[F.sum(f).alias(f) for f in fields])
    return rolled.where(F.col("household_id").isNotNull() & F.col("year").isNotNull()).withColumn(
        "kind", F.when(F.col("month").isNull(), "total").otherwise("month")
    )


def category_breakdown(ledger: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Rows and total per category and year, ranked by total then name."""
    grouped = ledger.groupBy(*scope, F.year("occurred_on").alias("year"), "primary_category").agg(
        F.count("*").alias("txn_count"), F.sum(F.abs("amount")).alias("total_usd")
    )
    ranked = Window.partitionBy(*scope, "year").orderBy(F.col("total_usd").desc(), "primary_category")
    return grouped.withColumn("position", F.row_number().over(ranked))


def annual_reference_ratios(reference: DataFrame) -> DataFrame:
    """Tax, take-home and deferral ratios per populated year; a year of zeros and no notes is left out."""
    amounts = [
        "gross_w2_a", "gross_w2_b", "federal_withholding", "state_withholding", "fica_employee",
        "contribution_a", "contribution_b", "employer_match_a", "employer_match_b",
        "hsa_contribution", "hsa_employer_contribution",
    ]
    populated = F.coalesce(F.trim("notes"), F.lit("")) != ""
    for name in amounts:
        populated = populated | (F.coalesce(name, F.lit(0)) != 0)
    gross = F.col("gross_w2_a") + F.col("gross_w2_b")
    withheld = F.col("federal_withholding") + F.col("state_withholding") + F.col("fica_employee")
    deferred = F.col("contribution_a") + F.col("contribution_b") + F.col("hsa_contribution")
    net = gross - withheld - deferred
    positive = gross > 0
    return reference.where(populated).select(
        *HOUSEHOLD, "year", gross.alias("gross_total"), withheld.alias("withholding_total"),
        deferred.alias("pretax_deferrals_total"), net.alias("net_take_home_estimate"),
        F.when(positive, _percent(withheld, gross)).alias("effective_tax_rate_pct"),
        F.when(positive, F.round(net.cast("double") / gross.cast("double"), 4)).alias("gross_to_net_ratio"),
        F.when(positive, _percent(deferred, gross)).alias("pretax_savings_rate_pct"), "notes",
    )


def months_present(ledger: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    return ledger.select(*scope, S.month_label("occurred_on").alias("month")).distinct()


def months_without_summary(ledger: DataFrame, stored: DataFrame, scope: Sequence[str] = HOUSEHOLD) -> DataFrame:
    """Months (and, as ``YYYY`` labels, years) that have rows but no stored summary."""
    months = months_present(ledger, scope)
    years = months.select(*scope, F.substring("month", 1, 4).alias("month")).distinct()
    labels = months.unionByName(years).withColumnRenamed("month", "label")
    return labels.join(stored.select(*scope, "label").distinct(), [*scope, "label"], "left_anti")


DRIFT_FIELDS = (
    "inflows",
    "fixed_obligations",
    "discretionary",
    "net_fcf",
    "net_consumption",
    "mortgage_principal_scheduled",
    "debt_paydown_nonscheduled",
)


def summary_drift(stored: DataFrame, recomputed: DataFrame, fields: Sequence[str] = DRIFT_FIELDS) -> DataFrame:
    """Stored figures against recomputed ones, one row per differing field.

    A stored month without rows, and a field absent from the store, are reported too.
    """
    keys = [*HOUSEHOLD, "label"]

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("decimal(28,2)").alias("v")) for f in fields])
        return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.field").alias("field"), F.col("p.v").alias(name))

    both = long(stored, "stored").withColumn("_s", F.lit(True)).join(
        long(recomputed, "computed").withColumn("_c", F.lit(True)), [*keys, "field"], "left"
    )
    note = (
        F.when(F.col("_c").isNull(), "month has no rows now")
        .when(F.col("stored").isNull(), "absent from the stored summary")
        .otherwise("differs")
    )
    differs = F.col("_c").isNull() | F.col("stored").isNull() | (F.col("stored") != F.col("computed"))
    return both.where(differs).select(
        *keys, "field", "stored", "computed", (F.col("computed") - F.col("stored")).alias("delta"), note.alias("note")
    )


def in_window(df: DataFrame, start, end) -> DataFrame:
    """Rows of ``[start, end)``."""
    return df.where((F.col("occurred_on") >= as_day(start)) & (F.col("occurred_on") < as_day(end)))

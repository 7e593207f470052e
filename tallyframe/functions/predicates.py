"""The single definition of each category scope.

Spend is decided by category: a ``transfer`` row in a spend category is spend,
and only ``inflow`` rows are held out of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category and subcategory sets.
DISCRETIONARY = ("variable_lifestyle", "medical", "abnormal")
SPEND = ("fixed_obligation", "variable_lifestyle", "medical", "abnormal")
SPEND_OFFSET = ("variable_lifestyle", "medical", "abnormal", "fixed_obligation")
SPEND_RULE = ("fixed_obligation", "variable_lifestyle", "medical", "abnormal", "business_expense")
INCOME_OFFSET_SUBCATEGORIES = ("insurance_reimbursement", "reimbursement", "refund")
PAY_DEPOSIT_SUBCATEGORIES = ("payroll", "paycheck", "bonus")
SUBSCRIPTION_SUBCATEGORIES = ("subscriptions_apps", "streaming")


def _category(*names: str) -> Column:
    return F.col("primary_category").isin(*names)


def not_inflow() -> Column:
    return F.col("direction") != "inflow"


def is_income() -> Column:
    return _category("income") & (F.col("direction") == "inflow")


def is_spend() -> Column:
    return _category(*SPEND) & not_inflow()


def is_fixed_obligation() -> Column:
    return _category("fixed_obligation") & not_inflow()


def is_discretionary() -> Column:
    return _category(*DISCRETIONARY) & not_inflow()


def is_income_offset() -> Column:
    return is_income() & F.col("subcategory").isin(*INCOME_OFFSET_SUBCATEGORIES)


def is_spend_offset() -> Column:
    return _category(*SPEND_OFFSET) & (F.col("direction") == "inflow")


def is_pay_deposit() -> Column:
    return is_income() & F.col("subcategory").isin(*PAY_DEPOSIT_SUBCATEGORIES)


def is_investment() -> Column:
    return _category("investment") & (F.col("direction") == "outflow")


def is_unclassified_backlog() -> Column:
    return _category("unclassified") & (F.col("direction") != "transfer")


def sum_where(condition: Column, value: Column | None = None) -> Column:
    """``sum`` of ``value`` (the ledger amount) over rows that satisfy ``condition``, 0 when none."""
    amount = F.col("amount") if value is None else value
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0).cast("decimal(28,2)"))

"""Register filters, ranges, paging and guarded ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.operators.common import as_day

PAGE_SIZE = 50
DRILL_DOWN_ROWS = 200
DETAIL_CAP = 50


def register_filter(
    *, direction: str = "all", category: str | None = None, account: str | None = None, search: str | None = None
) -> Column:
    """Predicate of the register: ``all`` leaves transfers out; ``%`` and ``_`` in the search are wildcards."""
    if direction in ("inflow", "outflow"):
        out = F.col("direction") == direction
    else:
        out = F.col("direction") != "transfer"
    if category and category != "all":
        out = out & (F.col("primary_category") == category)
    if account and account != "all":
        out = out & (F.col("account_id") == account)
    if search and search.strip():
        like = f"%{search.strip()}%"
        out = out & (F.coalesce(F.col("merchant_normalized").ilike(like), F.lit(False)) | F.col("description_raw").ilike(like))
    return out


def register_rows(ledger: DataFrame, accounts: DataFrame, condition: Column) -> DataFrame:
    labels = accounts.select("account_id", S.account_label().alias("account_label"))
    return ledger.where(condition).join(labels, "account_id")


def register_page(ledger: DataFrame, accounts: DataFrame, condition: Column, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One page, newest first."""
    ordered = register_rows(ledger, accounts, condition).orderBy(F.col("occurred_on").desc(), F.col("id").desc())
    return ordered.offset(page * size).limit(size)


def register_page_after(
    ledger: DataFrame, accounts: DataFrame, condition: Column, day: date | str, row_id: str, size: int = PAGE_SIZE
) -> DataFrame:
    """The page that follows a known last row: no offset is skipped, so deep pages cost the same."""
    older = (F.col("occurred_on") < as_day(day)) | ((F.col("occurred_on") == as_day(day)) & (F.col("id") < row_id))
    return register_page(ledger, accounts, condition & older, 0, size)


def register_total(ledger: DataFrame, accounts: DataFrame, condition: Column) -> DataFrame:
    return register_rows(ledger, accounts, condition).agg(F.count("*").alias("total"))


def account_options(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_id", "account_name", S.account_label().alias("label")).orderBy("account_name", "account_id")


def leakage_rows(ledger: DataFrame, category: str, first_month: str, last_month: str, limit: int = DRILL_DOWN_ROWS) -> DataFrame:
    """Newest outflows of a category between two months."""
    start, end = as_day(f"{first_month}-01"), F.last_day(as_day(f"{last_month}-01"))
    return (
        ledger.where(
            (F.col("direction") == "outflow") & (F.col("primary_category") == category) & F.col("occurred_on").between(start, end)
        )
        .select("id", S.vendor().alias("vendor"), F.abs("amount").alias("amount"), "occurred_on", "description_raw")
        .orderBy(F.col("occurred_on").desc(), F.col("id").desc())
        .limit(limit)
    )


def month_range(
    kind: str, as_of: date | str, *, start: str | None = None, end: str | None = None, month: str = "month"
) -> Column:
    """Predicate on a ``YYYY-MM`` column: year to date, last twelve months, all, or custom months."""
    label = F.col(month)
    if kind == "ytd":
        return label >= F.concat(F.date_format(as_day(as_of), "yyyy"), F.lit("-01"))
    if kind == "12mo":
        return label >= F.date_format(F.add_months(as_day(as_of), -11), "yyyy-MM")
    if kind == "custom":
        return label.between(start, end)
    if kind == "all":
        return F.lit(True)
    raise ValueError(f"unknown range {kind!r}")


def unclassified_count(ledger: DataFrame, scope: Sequence[str] = ("household_id",)) -> DataFrame:
    return ledger.where(P.is_unclassified_backlog()).groupBy(*scope).agg(F.count("*").alias("total"))


def cap_details(findings: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int = DETAIL_CAP) -> DataFrame:
    """The first ``cap`` rows per key with the full count beside them."""
    totals = findings.groupBy(*keys).agg(F.count("*").alias("details_total"))
    ranked = Window.partitionBy(*keys).orderBy(*order)
    few = findings.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= cap)
    return few.join(totals, list(keys))


READ_PREFIXES = ("select", "with")
WRITE_MARKS = ("Insert", "Command", "Create", "Drop", "Delete", "Update", "Merge", "Alter", "Truncate", "Overwrite", "Append", "Write", "Replace", "Cache", "Refresh")


# Functions that call into the JVM or read files.
UNSAFE_FUNCTIONS = ("reflect", "java_method", "try_reflect", "read_files", "input_file_name")


def _parts(names) -> list[str]:
    return [names.apply(i) for i in range(names.size())]


def _plan_nodes(gateway, node) -> list:
    """A parsed plan's nodes and expressions, those of subqueries and named queries too."""

    def is_a(x, name: str) -> bool:
        return is_instance_of(gateway, x, f"org.apache.spark.sql.catalyst.{name}")

    groups = [node.children(), node.innerChildren()]
    if is_a(node, "plans.logical.LogicalPlan"):
        groups.append(node.expressions())
    inside = [g.apply(i) for g in groups for i in range(g.size())]
    if is_a(node, "expressions.PlanExpression"):
        inside.append(node.plan())
    return [node, *[x for child in inside if is_a(child, "trees.TreeNode") for x in _plan_nodes(gateway, child)]]


def _refused(spark: SparkSession, plan) -> list[str]:
    out = set()
    for node in _plan_nodes(spark.sparkContext._gateway, plan):
        kind = node.getClass().getSimpleName()
        if any(mark in kind for mark in WRITE_MARKS):
            out.add(kind)
        if kind == "UnresolvedFunction" and _parts(node.nameParts())[-1].lower() in UNSAFE_FUNCTIONS:
            out.add(_parts(node.nameParts())[-1].lower())
        if kind == "UnresolvedRelation":
            name = _parts(node.multipartIdentifier())
            if len(name) > 1 and not spark.catalog.databaseExists(name[-2]):
                out.add(".".join(name))
    return sorted(out)


def read_only_sql(spark: SparkSession, text: str, args: Sequence[object] = ()) -> DataFrame:
    """Run a SELECT or WITH query with positional parameters; anything that writes,
    calls into the JVM or reads a path instead of a registered table is refused before it runs."""
    if not text.lstrip().lower().startswith(READ_PREFIXES):
        raise ValueError("only SELECT and WITH queries are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    bad = _refused(spark, plan)
    if bad:
        raise ValueError(f"query is not read-only: {', '.join(bad)}")
    return spark.sql(text, args=list(args)) if args else spark.sql(text)

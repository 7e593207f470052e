"""Data-quality checks. Each returns findings in one shape, so a run is their union.

Finding columns: check, family, severity (info, warn, fail), household_id, subject,
problem, row_count, amount. No finding means the check passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.operators import chains, loans, transfers
from tallyframe.operators import overrides as O
from tallyframe.operators.common import HOUSEHOLD, as_day, spread
from tallyframe.schema import CONFIDENCES, HOUSEHOLD_ROLES, LIFECYCLES, PRIMARY_CATEGORIES
from tallyframe.session import cut_lineage

FINDING = ("check", "family", "severity", "household_id", "subject", "problem", "row_count", "amount")

# Report order with families, grace days, ages, bands.
CHECKS = (
    ("duplicate_keys", "integrity"),
    ("cross_file_duplicates", "integrity"),
    ("vocabulary", "integrity"),
    ("income_rule_direction", "rules"),
    ("spend_rule_direction", "rules"),
    ("rule_bands", "rules"),
    ("orphaned_overrides", "overrides"),
    ("override_in_effect", "overrides"),
    ("recurring_income", "completeness"),
    ("tail_gap", "completeness"),
    ("early_download", "completeness"),
    ("unpaired_card_payments", "completeness"),
    ("self_anchor_chain", "balances"),
    ("stored_reconciliation", "balances"),
    ("balanced_clusters", "transfers"),
    ("orphan_transfers", "transfers"),
    ("pair_integrity", "transfers"),
    ("mortgage_schedule_miss", "mortgage"),
    ("mortgage_anchor_stale", "mortgage"),
    ("summary_drift", "summaries"),
    ("status_freshness", "summaries"),
    ("taxonomy", "labels"),
    ("null_merchant_spend", "labels"),
    ("benign_stale", "meta"),
    ("as_of_month", "meta"),
)
FAMILY = dict(CHECKS)
RANK = {"pass": 0, "info": 0, "warn": 1, "fail": 2, "error": 2}
GRACE_DAYS = 3
FRESHNESS_DAYS = 31
STRUCTURAL_PRIORITY = 5
MANUAL_BAND = (6, 9)
DATED_FILE = r"^(\d{4}-\d{2})_"


def findings(
    df: DataFrame,
    check: str,
    severity: Column | str,
    subject: Column,
    problem: Column | str,
    rows: Column | int = 1,
    amount: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` in the finding shape."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    household = F.col("household_id") if "household_id" in df.columns else F.lit(None).cast("string")
    value = F.lit(None).cast("double") if amount is None else amount.cast("double")
    return df.select(
        F.lit(check).alias("check"), F.lit(FAMILY[check]).alias("family"), lit(severity).alias("severity"), household.alias("household_id"),
        subject.cast("string").alias("subject"), lit(problem).alias("problem"), lit(rows).cast("bigint").alias("row_count"), value.alias("amount"),
    )


# --- integrity ---------------------------------------------------------------


def duplicate_keys(ledger: DataFrame) -> DataFrame:
    groups = ledger.groupBy(*HOUSEHOLD, "account_id", "source_record_key").agg(F.count("*").alias("n")).where("n > 1")
    subject = F.concat_ws("|", "account_id", "source_record_key")
    return findings(groups, "duplicate_keys", "fail", subject, "record key occurs more than once", F.col("n"))


def cross_file_duplicates(ledger: DataFrame) -> DataFrame:
    """Equal postings from several files fail; repeats inside one file are genuine."""
    keys = [*HOUSEHOLD, "account_id", "occurred_on", "amount", "description_raw"]
    groups = (
        ledger.groupBy(*keys, "source_document_name")
        .agg(F.count("*").alias("copies"))
        .groupBy(*keys)
        .agg(F.sum("copies").alias("n"), F.array_sort(F.collect_list("source_document_name")).alias("files"))
        .where("n > 1")
    )
    subject = F.concat_ws("|", "account_id", "occurred_on", "description_raw")
    crossed = F.size("files") > 1
    problem = F.when(crossed, F.concat(F.lit("in "), F.size("files").cast("string"), F.lit(" files: "), F.array_join("files", ", "))).otherwise(
        "repeated inside one file"
    )
    return findings(groups, "cross_file_duplicates", F.when(crossed, "fail").otherwise("info"), subject, problem, F.col("n"), F.col("amount"))


def duplicate_documents(ledger: DataFrame) -> DataFrame:
    """The documents of each cross-file duplicate, one row per posting and document."""
    keys = [*HOUSEHOLD, "account_id", "occurred_on", "amount", "description_raw"]
    named = ledger.groupBy(*keys, "source_document_name").agg(F.count("*").alias("copies"))
    several = named.groupBy(*keys).agg(F.count("*").alias("files")).where("files > 1")
    return named.join(several, keys)


def _outside(df: DataFrame, vocabulary: dict[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Values of each column outside its vocabulary, with counts; nulls count as outside."""
    pairs = F.array(
        *[
            F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), F.struct(F.lit(c).alias("field"), F.col(c).alias("value")))
            for c, allowed in vocabulary.items()
        ]
    )
    bad = df.select(*keys, F.explode(F.array_compact(pairs)).alias("v"))
    return bad.groupBy(*keys, F.col("v.field").alias("field"), F.col("v.value").alias("value")).agg(F.count("*").alias("n"))


def vocabulary(ledger: DataFrame, rules: DataFrame | None = None, roles: Sequence[str] = HOUSEHOLD_ROLES) -> DataFrame:
    """Label values outside the closed vocabulary, in the ledger and in the rules."""
    closed = {"primary_category": PRIMARY_CATEGORIES, "lifecycle": LIFECYCLES, "household_role": tuple(roles)}
    problem = F.concat(F.lit("value outside the vocabulary: "), F.coalesce(F.col("value"), F.lit("(null)")))
    out = findings(_outside(ledger, closed, HOUSEHOLD), "vocabulary", "fail", F.concat(F.lit("ledger."), F.col("field")), problem, F.col("n"))
    if rules is None:
        return out
    # A rule may leave a label alone, its confidence it may not.
    filled = rules.withColumns({c: F.coalesce(F.col(c), F.lit(v[0])) for c, v in closed.items()})
    bad = _outside(filled, {**closed, "confidence": CONFIDENCES}, ["id"])
    subject = F.concat(F.lit("rule "), F.col("id"), F.lit("."), F.col("field"))
    return out.unionByName(findings(bad, "vocabulary", "fail", subject, problem))


# --- rules -------------------------------------------------------------------


def income_rule_direction(rules: DataFrame) -> DataFrame:
    bad = rules.where((F.col("primary_category") == "income") & ~F.col("direction_filter").eqNullSafe("inflow"))
    return findings(bad, "income_rule_direction", "warn", F.col("id"), "income rule is not limited to inflows")


def spend_rule_direction(rules: DataFrame, exceptions: Sequence[str] = ()) -> DataFrame:
    bad = rules.where(F.col("primary_category").isin(*P.SPEND_RULE) & ~F.col("direction_filter").eqNullSafe("outflow"))
    if exceptions:
        bad = bad.where(~F.col("id").isin(*exceptions))
    return findings(bad, "spend_rule_direction", "warn", F.col("id"), "spend rule is not limited to outflows")


def pattern_errors(rules: DataFrame) -> DataFrame:
    """Rules whose pattern the regex engine refuses: each pattern is compiled where its row is."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?i)"), F.col("pattern")))
    bad = rules.where(F.col("pattern").isNotNull() & compiled.isNull())
    return findings(bad, "rule_bands", "fail", F.col("id"), "pattern does not compile")


def rule_bands(rules: DataFrame) -> DataFrame:
    low, high = MANUAL_BAND
    p = F.col("priority")
    structural = (p == STRUCTURAL_PRIORITY) & ~F.col("primary_category").eqNullSafe("transfer")
    problem = (
        F.when(structural, "priority 5 is kept for transfer rules")
        .when(p.between(low, high), "in the manual band")
        .when(p < STRUCTURAL_PRIORITY, "priority below every band")
    )
    bad = rules.withColumn("_problem", problem).where(F.col("_problem").isNotNull())
    return findings(bad, "rule_bands", F.when(structural, "fail").otherwise("info"), F.col("id"), F.col("_problem"))


# --- overrides ---------------------------------------------------------------


def orphaned_overrides(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    return findings(O.orphaned_overrides(ledger, overrides), "orphaned_overrides", "warn", F.col("match_key"), "override matches no row", 1, F.col("amount"))


def override_in_effect(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Governed rows whose override does not show or is not flagged; flagged rows without one are noted."""
    effect = O.override_effect(ledger, overrides).where("NOT in_effect")
    problem = F.when(F.col("differs") != "", F.concat(F.lit("differs: "), F.col("differs"))).otherwise("flag is missing")
    off = findings(effect, "override_in_effect", "warn", F.col("id"), problem, 1, F.col("amount"))
    loose = O.flagged_without_override(ledger, overrides)
    return off.unionByName(findings(loose, "override_in_effect", "info", F.col("id"), "flagged without an override", 1, F.col("amount")))


# --- completeness ------------------------------------------------------------


def as_of_month(ledger: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per household: the earliest of the anchor accounts' newest months, and the account that limits it."""
    last = ledger.groupBy(*HOUSEHOLD, "account_id").agg(F.date_format(F.max("occurred_on"), "yyyy-MM").alias("newest"))
    joined = anchors.select(*HOUSEHOLD, "account_id").join(last, [*HOUSEHOLD, "account_id"], "left")
    limit = F.min(F.when(F.col("newest").isNotNull(), F.struct("newest", "account_id")))
    return joined.groupBy(*HOUSEHOLD).agg(limit.alias("m"), F.count_if(F.col("newest").isNull()).alias("missing")).select(
        *HOUSEHOLD, F.col("m.newest").alias("as_of_month"), F.col("m.account_id").alias("limiting_account"), "missing"
    )


def as_of_findings(months: DataFrame, explicit: str | None = None) -> DataFrame:
    """The resolved month; a household without rows, or an explicit month beyond it, is a warning."""
    if explicit is None:
        severity = F.when(F.col("as_of_month").isNull(), "warn").otherwise("info")
        problem = F.when(F.col("as_of_month").isNull(), "anchor accounts have no rows").otherwise(
            F.concat(F.lit("latest complete month "), F.col("as_of_month"))
        )
    else:
        beyond = F.coalesce(F.lit(explicit) > F.col("as_of_month"), F.lit(True))
        severity = F.when(beyond, "warn").otherwise("info")
        problem = F.when(beyond, f"{explicit} requested beyond the latest complete month").otherwise(f"{explicit} requested")
    return findings(months, "as_of_month", severity, F.coalesce("limiting_account", F.lit("none")), problem)


def stream_matches(ledger: DataFrame, streams: DataFrame) -> DataFrame:
    """Rows that match an income stream of their account (pattern and amount range)."""
    fits = (
        (F.col("amount") > 0)
        & F.rlike("description_raw", F.concat(F.lit("(?i)"), F.col("pattern")))
        & (F.col("amount") >= F.col("min_amount"))
        & (F.col("max_amount").isNull() | (F.col("amount") <= F.col("max_amount")))
    )
    return ledger.join(streams, "account_id").where(fits)


def income_fill(ledger: DataFrame, streams: DataFrame, months: DataFrame) -> DataFrame:
    """Rows each stream month gets when months are filled in order, each row used once.

    A month takes up to ``min_per_month`` rows from its own days, then from the first days of
    the next month. Only monthly counts matter, so the fold runs over an array of months.
    ``months(household_id, as_of_month)``.
    """
    last_month = F.to_date(F.concat(F.col("as_of_month"), F.lit("-01")))
    start = ledger.groupBy(*HOUSEHOLD, "account_id").agg(F.trunc(F.min("occurred_on"), "month").alias("first_month"))
    spans = streams.join(start, "account_id").join(months, list(HOUSEHOLD)).withColumn("last_month", last_month)
    grid = spans.select(
        "name", "account_id", *HOUSEHOLD, "min_per_month", "last_month",
        F.explode(F.sequence("first_month", F.greatest(F.add_months("last_month", 1), F.col("first_month")), F.expr("interval 1 month"))).alias("month_start"),
    )
    hits = stream_matches(ledger, streams).groupBy("name", "account_id", F.trunc("occurred_on", "month").alias("month_start")).agg(
        F.count("*").alias("n"), F.count_if(F.dayofmonth("occurred_on") <= GRACE_DAYS).alias("early")
    )
    counted = grid.join(hits, ["name", "account_id", "month_start"], "left")
    following = Window.partitionBy("name", "account_id").orderBy("month_start")
    item = F.struct("month_start", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("next_early", F.lit(0)).alias("next_early"))
    arrays = (
        counted.withColumn("next_early", F.lead("early").over(following))
        .where(F.col("month_start") <= F.col("last_month"))
        .groupBy("name", "account_id", *HOUSEHOLD, "min_per_month", "last_month")
        .agg(F.array_sort(F.collect_list(item)).alias("ms"))
    )
    need = F.col("min_per_month").cast("bigint")

    def step(acc: Column, m: Column) -> Column:
        own = m["n"] - acc["borrowed"]
        borrowed = F.least(m["next_early"], F.greatest(F.lit(0).cast("bigint"), need - own))
        found = F.struct(m["month_start"].alias("month_start"), (F.least(need, own) + borrowed).alias("found"))
        return F.struct(borrowed.alias("borrowed"), F.concat(acc["out"], F.array(found)).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("borrowed"), F.array().cast("array<struct<month_start:date,found:bigint>>").alias("out"))
    filled = arrays.withColumn("r", F.aggregate("ms", zero, step, lambda acc: acc["out"]))
    return filled.select("name", "account_id", *HOUSEHOLD, "min_per_month", "last_month", F.explode("r").alias("x")).select(
        "name", "account_id", *HOUSEHOLD, "x.month_start", "x.found", F.col("min_per_month").cast("bigint").alias("required"),
        (F.col("x.month_start") == F.col("last_month")).alias("is_as_of"),
    )


def recurring_income(ledger: DataFrame, streams: DataFrame, months: DataFrame) -> DataFrame:
    """Short months per stream (the as-of month fails), accounts without rows, and label drift."""
    short = income_fill(ledger, streams, months).where("found < required")
    subject = F.concat_ws("|", "name", S.month_label("month_start"))
    out = findings(short, "recurring_income", F.when(F.col("is_as_of"), "fail").otherwise("warn"), subject, "month is short of income rows", F.col("found"))
    silent = streams.join(ledger.select("account_id"), "account_id", "left_anti")
    out = out.unionByName(findings(silent, "recurring_income", "fail", F.col("name"), "account has no rows", 0))
    matched = stream_matches(ledger, streams).join(months, list(HOUSEHOLD))
    window_end = F.date_add(F.last_day(F.to_date(F.concat(F.col("as_of_month"), F.lit("-01")))), GRACE_DAYS)
    off = (F.col("expected_subcategory").isNotNull() & ~F.col("subcategory").eqNullSafe(F.col("expected_subcategory"))) | (
        F.col("expected_role").isNotNull() & ~F.col("household_role").eqNullSafe(F.col("expected_role"))
    )
    drift = matched.where(off & (F.col("occurred_on") <= window_end))
    return out.unionByName(findings(drift, "recurring_income", "info", F.concat_ws("|", "name", "id"), "label differs from the stream's", 1, F.col("amount")))


def dated_files(ledger: DataFrame, limits: DataFrame, life_files: Sequence[str] = ()) -> DataFrame:
    """Dated monthly files of the watched accounts, with their last row."""
    month = F.regexp_extract("source_document_name", DATED_FILE, 1)
    files = ledger.groupBy(*HOUSEHOLD, "source_document_name", "account_id").agg(F.max("occurred_on").alias("last_row"), F.count("*").alias("n"))
    files = files.withColumn("month", month).where("month <> ''").join(limits.select("account_id", "days"), "account_id")
    return files.where(~F.col("source_document_name").isin(*life_files)) if life_files else files


def tail_gap(ledger: DataFrame, limits: DataFrame, months: DataFrame, life_files: Sequence[str] = ()) -> DataFrame:
    """Dated files that stop too long before their month end, and watched accounts silent in the as-of month.

    ``limits(household_id, account_id, days)``; an account without any row is silent too.
    """
    end = F.last_day(F.to_date(F.concat(F.col("month"), F.lit("-01"))))
    gap = F.datediff(end, "last_row")
    files = dated_files(ledger, limits, life_files).join(months, list(HOUSEHOLD)).where(F.col("month") <= F.col("as_of_month"))
    short = files.withColumn("gap", gap).where(F.col("gap") > F.col("days"))
    subject = F.concat_ws("|", "account_id", "source_document_name")
    problem = F.concat(F.lit("last row "), F.col("gap").cast("string"), F.lit(" days before the month end"))
    out = findings(short, "tail_gap", "warn", subject, problem, F.col("n"))
    active = ledger.select(*HOUSEHOLD, "account_id", S.month_label("occurred_on").alias("as_of_month")).distinct()
    watched = limits.join(months, list(HOUSEHOLD)).select(*HOUSEHOLD, "account_id", "as_of_month")
    silent = watched.join(active, [*HOUSEHOLD, "account_id", "as_of_month"], "left_anti")
    return out.unionByName(findings(silent, "tail_gap", "warn", F.col("account_id"), "no rows in the as-of month", 0))


def early_download(ledger: DataFrame, limits: DataFrame, months: DataFrame, catalogue: DataFrame, life_files: Sequence[str] = ()) -> DataFrame:
    """As-of-month files that were last written on or before the month end.

    ``catalogue(relative_path, modified)``; a file found in several places is judged by the first path.
    """
    files = dated_files(ledger, limits, life_files).join(months, list(HOUSEHOLD)).where(F.col("month") == F.col("as_of_month"))
    disk = catalogue.groupBy(F.substring_index("relative_path", "/", -1).alias("source_document_name")).agg(
        F.min(F.struct("relative_path", "modified")).alias("f"), F.count("*").alias("places")
    )
    end = F.last_day(F.to_date(F.concat(F.col("month"), F.lit("-01"))))
    joined = files.join(disk, "source_document_name", "left")
    early = F.to_date("f.modified") <= end
    problem = (
        F.when(F.col("f").isNull(), "file not found below the watch folder")
        .when(early, "downloaded on or before the month end")
        .when(F.col("places") > 1, "same file name in more than one place")
    )
    found = joined.withColumn("_p", problem).where(F.col("_p").isNotNull())
    severity = F.when(F.coalesce(early, F.lit(False)), "warn").otherwise("info")
    return findings(found, "early_download", severity, F.concat_ws("|", "account_id", "source_document_name"), F.col("_p"), F.col("n"))


def card_payment_candidates(unpaired: DataFrame, accounts: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Unexplained unpaired rows that look like card payments, on the card or on the checking side."""
    kinds = accounts.select("account_id", "account_type")
    on_card = (F.col("account_type") == "credit_card") & (F.col("amount") > 0)
    on_checking = (F.col("account_type") == "checking") & S.any_pattern("description_raw", patterns)
    return unpaired.where("NOT in_cluster").join(kinds, "account_id").where(on_card | on_checking)


def unpaired_card_payments(candidates: DataFrame) -> DataFrame:
    return findings(candidates, "unpaired_card_payments", "fail", F.col("id"), "card payment without its other leg", 1, F.col("amount"))


# --- balances ----------------------------------------------------------------


def self_anchor_chain(rows: DataFrame, openings: DataFrame, seed_day: date | str) -> DataFrame:
    """Breaks between months, a first month that misses its opening, ambiguous boundary days, partial balances."""
    # five findings read the months, which are few beside the rows
    months = cut_lineage(chains.month_chains(rows))
    label = F.concat_ws("|", "account_id", S.month_label("month_start"))
    first = (F.col("opening_ambiguous")) | (F.col("closing_ambiguous") & (F.col("last_day") != F.col("first_day")))
    out = findings(months.where(first), "self_anchor_chain", "warn", label, "order of a boundary day is ambiguous")
    broken = months.where("broken")
    delta = F.col("opening") - F.col("prior_closing")
    out = out.unionByName(findings(broken, "self_anchor_chain", "fail", label, "opening does not continue the prior closing", 1, delta))
    from_seed = F.add_months(F.trunc(as_day(seed_day), "month"), 1)
    seeded = months.where(F.col("month_start") >= from_seed).groupBy("account_id").agg(
        F.min(F.struct("month_start", "opening")).alias("m")
    ).select("account_id", "m.*")
    seeded = seeded.join(openings.select("account_id", "balance"), "account_id", "left")
    wrong = seeded.where(F.col("opening").isNotNull() & (F.col("opening") != F.col("balance")))
    out = out.unionByName(findings(wrong, "self_anchor_chain", "fail", label, "first opening differs from the configured one", 1, F.col("opening") - F.col("balance")))
    unknown = seeded.where(F.col("balance").isNull())
    out = out.unionByName(findings(unknown, "self_anchor_chain", "info", label, "no configured opening"))
    partial = chains.partly_balanced_accounts(rows)
    return out.unionByName(findings(partial, "self_anchor_chain", "info", F.col("account_id"), "running balance on some rows only"))


def reconciliation_findings(
    ledger: DataFrame,
    accounts: DataFrame,
    periods: DataFrame,
    closings: DataFrame,
    balances: DataFrame,
    *,
    as_of_month: str,
    as_of: date | str,
) -> DataFrame:
    """Stored periods against running-balance chains, checkpoints and computed card balances.

    ``ledger`` carries ``running_balance``; ``balances`` is the computed balance table.
    Columns: account_id, period_end, kind, problem, variance.
    """
    start = F.to_date(F.lit(f"{as_of_month}-01"))
    end = F.last_day(start)
    shape = ledger.groupBy("account_id").agg((F.count("running_balance") > 0).alias("has_balance"))
    cash = accounts.where("account_type <> 'credit_card'").join(shape, "account_id", "left").where("NOT coalesce(has_balance, false)")
    marks = closings.join(cash.select("account_id"), "account_id").select("account_id", "as_of", "balance")

    # Few periods are read: those of the as-of month and those that end on a checkpoint or the day before it.
    whole = (F.col("period_start") == start) & (F.col("period_end") == end)
    # dealt like reconciled periods, which outnumber rows many times and so stay where they are
    asked = marks.repartition(spread(accounts), "account_id").groupBy("account_id").agg(F.collect_set("as_of").alias("_asked"))
    marked = F.array_contains("_asked", F.col("period_end")) | F.array_contains("_asked", F.date_add("period_end", 1))
    periods = periods.select("account_id", "period_start", "period_end", "statement_closing", "computed_closing", "variance")
    periods = cut_lineage(periods.join(asked, "account_id", "left").where(whole | F.coalesce(marked, F.lit(False))).drop("_asked"))
    full_month = periods.where(whole).select("account_id", "computed_closing", "variance", F.lit(True).alias("_row"))

    def shaped(df: DataFrame, kind: str, problem: Column, variance: Column, day: Column) -> DataFrame:
        out = df.withColumn("_p", problem).where(F.col("_p").isNotNull())
        return out.select("account_id", day.alias("period_end"), F.lit(kind).alias("kind"), F.col("_p").alias("problem"), variance.cast("decimal(18,2)").alias("variance"))

    months = chains.month_chains(ledger).where(F.col("month_start") <= start)
    newest = months.groupBy("account_id").agg(F.max(F.struct("month_start", "closing"))["closing"].alias("chain_closing"))
    anchored = newest.join(full_month, "account_id", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("variance").isNull(), "no statement closing").when(F.col("variance") != 0, "variance is not zero"),
            F.when(F.col("chain_closing").isNull(), "no clear running-balance closing").when(
                ~F.col("computed_closing").eqNullSafe(F.col("chain_closing")), "computed closing differs from the chain"
            ),
        )
    )
    text = F.when(F.col("_row").isNull(), "no period for the as-of month").when(F.size(problems) > 0, F.array_join(problems, "; "))
    out = shaped(anchored, "self_anchoring", text, F.col("variance"), end)

    at_day = periods.groupBy("account_id", F.col("period_end").alias("as_of")).agg(
        F.count("*").alias("rows_at"), F.min(F.when(F.col("variance").isNotNull(), F.struct("period_start", "variance")))["variance"].alias("v")
    )
    prior = periods.groupBy("account_id", F.date_add("period_end", 1).alias("as_of")).agg(
        F.max(
            F.when(
                F.coalesce("computed_closing", "statement_closing").isNotNull(),
                F.struct("period_start", F.coalesce("computed_closing", "statement_closing").alias("c")),
            )
        )["c"].alias("prior_closing")
    )
    same_day = ledger.groupBy("account_id", F.col("occurred_on").alias("as_of")).agg(F.sum("amount").alias("moved"))
    keys = ["account_id", "as_of"]
    checked = marks.join(at_day, keys, "left").join(prior, keys, "left").join(same_day, keys, "left")
    off = F.col("balance") - F.col("prior_closing") - F.coalesce("moved", F.lit(0))
    text = (
        F.when(F.col("v").isNotNull(), F.when(F.col("v") != 0, "checkpoint variance"))
        .when(F.col("rows_at").isNull(), "checkpoint is not in the stored periods")
        .when(F.col("prior_closing").isNull(), "no period ending the day before to verify against")
        .when(off != 0, "checkpoint differs from the computed balance")
    )
    variance = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("rows_at").isNotNull(), off)
    out = out.unionByName(shaped(checked, "checkpoint", text, variance, F.col("as_of")))

    cards = balances.where("account_type = 'credit_card'").select("account_id", "anchor_date", "computed_balance").join(full_month, "account_id")
    after = (
        ledger.where((F.col("occurred_on") > end) & (F.col("occurred_on") <= as_day(as_of)))
        .groupBy("account_id")
        .agg(F.sum(S.posted_effect()).alias("moved"))
    )
    known = cards.where(F.col("computed_balance").isNotNull() & F.col("computed_closing").isNotNull()).join(after, "account_id", "left")
    out = out.unionByName(
        shaped(known, "credit_card", F.when(F.col("computed_closing") < 0, "card balance is a credit"), F.lit(None), end)
    )
    diff = F.col("computed_balance") - (F.col("computed_closing") - F.coalesce("moved", F.lit(0)))
    drifted = F.when((F.col("anchor_date") <= end) & (diff != 0), "computed balance differs from the stored chain")
    return out.unionByName(shaped(known, "credit_card", drifted, diff, end))


def stored_reconciliation(found: DataFrame) -> DataFrame:
    subject = F.concat_ws("|", "account_id", "period_end", "kind")
    return findings(found, "stored_reconciliation", "warn", subject, F.col("problem"), 1, F.col("variance"))


# --- transfers ---------------------------------------------------------------


def balanced_clusters(ledger: DataFrame) -> DataFrame:
    found = transfers.balanced_clusters(ledger)
    subject = F.concat_ws("|", F.col("cents").cast("string"), "first_on", "last_on")
    return findings(found, "balanced_clusters", "info", subject, "unpaired legs that net to zero", F.col("legs"), F.col("cents") / 100)


def orphan_transfers(unpaired: DataFrame) -> DataFrame:
    loose = unpaired.where("NOT in_cluster")
    return findings(loose, "orphan_transfers", "warn", F.col("id"), "unpaired transfer row", 1, F.col("amount"))


def pair_integrity(ledger: DataFrame) -> DataFrame:
    """Transfer groups that are not two opposite legs of two accounts netting to zero, all of category transfer."""
    cents = S.cents("amount")
    groups = ledger.where(F.col("transfer_group_key").isNotNull()).groupBy(*HOUSEHOLD, "transfer_group_key").agg(
        F.count("*").alias("legs"), F.min("account_id").alias("lo"), F.max("account_id").alias("hi"), F.sum(cents).alias("net"),
        F.min(cents).alias("least"), F.max(cents).alias("most"), F.count_if(~F.col("primary_category").eqNullSafe("transfer")).alias("off_category"),
    )
    two = F.col("legs") == 2
    problems = F.array_compact(
        F.array(
            F.when(~two, F.concat(F.col("legs").cast("string"), F.lit(" rows"))),
            F.when(two & (F.col("lo") == F.col("hi")), F.lit("both legs on one account")),
            F.when(two & ~((F.col("least") < 0) & (F.col("most") > 0)), F.lit("legs are not opposite")),
            F.when(two & (F.col("net") != 0), F.lit("legs do not net to zero")),
            F.when(F.col("off_category") > 0, F.lit("leg outside category transfer")),
        )
    )
    bad = groups.withColumn("_p", F.array_join(problems, "; ")).where("_p <> ''")
    return findings(bad, "pair_integrity", "fail", F.col("transfer_group_key"), F.col("_p"), F.col("legs"), F.col("net") / 100)


def no_groups_at_all(ledger: DataFrame) -> DataFrame:
    """Households with transfer rows but not one transfer group: pairing has not run."""
    counts = ledger.groupBy(*HOUSEHOLD).agg(
        F.count_if(F.col("transfer_group_key").isNotNull()).alias("grouped"), F.count_if(F.col("primary_category") == "transfer").alias("n")
    )
    bad = counts.where("grouped = 0 AND n > 0")
    return findings(bad, "pair_integrity", "fail", F.lit("all"), "transfer rows but no transfer group; pair first", F.col("n"))


# --- mortgage, summaries, labels ---------------------------------------------


def mortgage_schedule_miss(debt: DataFrame) -> DataFrame:
    bad = debt.where("mortgage_principal_scheduled = 0")
    return findings(bad, "mortgage_schedule_miss", "warn", S.month_label("month_start"), "loan rows but no scheduled principal", 1, F.col("debt_paydown_nonscheduled"))


def mortgage_anchor_stale(ledger: DataFrame, loan_table: DataFrame, anchors: DataFrame) -> DataFrame:
    """Loans whose newest anchor governs an earlier month than their newest row."""
    rows = loans.loan_rows(ledger, loan_table).groupBy(*HOUSEHOLD, "loan").agg(F.trunc(F.max("occurred_on"), "month").alias("newest"))
    marks = anchors.groupBy("loan").agg(F.max(S.next_month_start("statement_date")).alias("governs"))
    stale = rows.join(marks, "loan", "left").where(F.col("governs").isNull() | (F.col("governs") < F.col("newest")))
    problem = F.concat(F.lit("anchor governs "), F.coalesce(S.month_label("governs"), F.lit("nothing")), F.lit(", rows run to "), S.month_label("newest"))
    return findings(stale, "mortgage_anchor_stale", "warn", F.col("loan"), problem)


def summary_drift(drift: DataFrame, missing: DataFrame) -> DataFrame:
    """Drifted stored figures, and months or years without a stored summary."""
    out = findings(drift, "summary_drift", "warn", F.concat_ws("|", "label", "field"), F.col("note"), 1, F.col("delta"))
    return out.unionByName(findings(missing, "summary_drift", "info", F.col("label"), "rows but no stored summary"))


def status_freshness(batches: DataFrame, verified: date | str, today: date | str) -> DataFrame:
    """The last verification is too old, or older than the last import."""
    newest = batches.agg(F.max("imported_at").cast("date").alias("latest"))
    age = F.datediff(as_day(today), as_day(verified))
    problems = F.array_compact(
        F.array(
            F.when(age > FRESHNESS_DAYS, F.concat(F.lit("last verified "), age.cast("string"), F.lit(" days ago"))),
            F.when(as_day(verified) < F.col("latest"), F.lit("last verified before the latest import")),
        )
    )
    bad = newest.withColumn("_p", F.array_join(problems, "; ")).where("_p <> ''")
    return findings(bad, "status_freshness", "warn", as_day(verified), F.col("_p"))


def taxonomy(ledger: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias and non-canonical subcategories, categories without a list, subcategories used by several categories.

    ``canonical(primary_category, subcategory)``, ``aliases(alias, canonical)``.
    """
    used = ledger.groupBy(*HOUSEHOLD, "primary_category", "subcategory").agg(F.count("*").alias("n"))
    listed = canonical.select("primary_category").distinct().withColumn("_listed", F.lit(True))
    allowed = canonical.distinct().withColumn("_ok", F.lit(True))
    named = aliases.select(F.col("alias").alias("subcategory"), F.col("canonical").alias("_alias"))
    joined = (
        used.join(named, "subcategory", "left").join(listed, "primary_category", "left").join(allowed, ["primary_category", "subcategory"], "left")
    )
    plain = F.col("_alias").isNull()
    sub_null = F.col("subcategory").isNull()
    odd = plain & F.col("_listed").isNotNull() & ((sub_null & (F.col("primary_category") != "transfer")) | (~sub_null & F.col("_ok").isNull()))
    unlisted = plain & F.col("_listed").isNull() & F.col("primary_category").isin(*PRIMARY_CATEGORIES)
    problem = (
        F.when(~plain, F.concat(F.lit("alias of "), F.col("_alias"))).when(odd, "not a canonical subcategory").when(unlisted, "category has no canonical list")
    )
    marked = joined.withColumn("_p", problem).withColumn("_info", unlisted).where(F.col("_p").isNotNull())
    subject = F.when(F.col("_info"), F.col("primary_category")).otherwise(
        F.concat_ws("|", "primary_category", F.coalesce("subcategory", F.lit("(null)")))
    )
    grouped = marked.groupBy(*HOUSEHOLD, subject.alias("s"), F.col("_p").alias("p"), F.col("_info").alias("i")).agg(F.sum("n").alias("n"))
    out = findings(grouped, "taxonomy", F.when(F.col("i"), "info").otherwise("warn"), F.col("s"), F.col("p"), F.col("n"))
    several = used.where(F.col("subcategory").isNotNull() & F.col("primary_category").isNotNull()).groupBy(*HOUSEHOLD, "subcategory").agg(
        F.array_sort(F.collect_set("primary_category")).alias("cats"), F.sum("n").alias("n")
    ).where(F.size("cats") > 1)
    problem = F.concat(F.lit("used under "), F.array_join("cats", ", "))
    return out.unionByName(findings(several, "taxonomy", "info", F.col("subcategory"), problem, F.col("n")))


def null_merchant_spend(ledger: DataFrame) -> DataFrame:
    grouped = ledger.where(P.is_spend() & F.col("merchant_normalized").isNull()).groupBy(*HOUSEHOLD, "primary_category").agg(
        F.count("*").alias("n"), F.sum(F.abs("amount")).alias("total")
    )
    return findings(grouped, "null_merchant_spend", "info", F.col("primary_category"), "spend without a merchant", F.col("n"), F.col("total"))


# --- known-benign findings -----------------------------------------------------




#: Each entry is filed under so many keys and each row looks under one of them: a row everybody's entries are about is spread.
BENIGN_SALTS = 16
# Entries that are sent to all tasks at most.
FEW_ENTRIES = 2_000
_ANY = "*"


def _met(rows: DataFrame, entries: DataFrame, named: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows with each entry whose named columns equal theirs; an entry's null stands for any value.

    A row looks under its own values and under "any" for each column, an entry is filed under what it
    names: one equi-join, however many entries there are. They are counted first: few ones are sent to all
    tasks, so that rows, which look under several keys each, are not shuffled.
    """
    few = entries.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES
    dealt = 1 if few else BENIGN_SALTS

    def key(parts: Sequence[Column], salt: Column) -> Column:
        return F.concat(*[x for part in parts for x in (part, F.lit("\u0001"))], salt.cast("string"))

    own = [(F.concat(F.lit("="), F.col(row).cast("string")), F.lit(_ANY)) for row, _ in named]
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(dealt))
    looked_up = rows.withColumn("_salt", salt).withColumn("_key", F.explode(F.array_compact(F.array(*[key(parts, F.col("_salt")) for parts in product(*own)]))))
    kept = [F.coalesce(F.concat(F.lit("="), F.col(entry).cast("string")), F.lit(_ANY)) for _, entry in named]
    salts = F.explode(F.sequence(F.lit(0), F.lit(dealt - 1)))
    filed = entries.withColumn("_s", salts).withColumn("_key", key(kept, F.col("_s"))).drop("_s")
    return looked_up.join(F.broadcast(filed) if few else filed, "_key").drop("_key", "_salt")


def _about(rows: DataFrame, benign: DataFrame) -> DataFrame:
    """Rows of the ledger each entry is about: its account, and its pattern or else its day."""
    day = F.when(F.col("pattern").isNull(), F.col("occurred_on"))
    entries = benign.select(
        F.col("id").alias("b_id"), F.col("account_id").alias("b_account"), day.alias("b_on"), F.col("pattern").alias("b_pattern"), F.col("occurred_on").alias("b_day")
    )
    met = _met(rows, entries, (("account_id", "b_account"), ("occurred_on", "b_on")))
    fits = F.col("b_pattern").isNull() | F.rlike(F.col("description_raw"), F.concat(F.lit("(?i)"), F.col("b_pattern")))
    return met.where(fits).select(*rows.columns, "b_id", "b_day")


def benign_transactions(ledger: DataFrame, suspects: DataFrame, benign: DataFrame, check: str) -> DataFrame:
    """Each benign entry of a row-level check: rows it suppresses and why it is falsified, if it is.

    Count and net are over every row the entry is about, whatever its day or pairing; the
    amount only over rows of the named day. ``benign`` may be of any length.
    """
    rows = benign.where(F.col("check") == check)
    scope = _about(ledger, rows)
    named = F.col("b_day").isNull() | (F.col("b_day") == F.col("occurred_on"))
    totals = scope.join(rows.select(F.col("id").alias("b_id"), F.col("amount").alias("b_amount")), "b_id").groupBy("b_id").agg(
        F.count("*").alias("rows_about"), F.sum("amount").alias("net"), F.count_if(named & (F.col("amount") != F.col("b_amount"))).alias("other_amounts")
    )
    hit = _about(suspects, rows).where(named).groupBy("b_id").agg(F.count("*").alias("suppressed"))
    judged = rows.withColumnRenamed("id", "b_id").join(totals, "b_id", "left").join(hit, "b_id", "left")
    count, net = F.coalesce("rows_about", F.lit(0)), F.coalesce("net", F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("expected_count").isNotNull() & (count != F.col("expected_count")), F.lit("count")),
            F.when(F.col("expected_net").isNotNull() & (net != F.col("expected_net")), F.lit("net")),
            F.when(F.coalesce("other_amounts", F.lit(0)) > 0, F.lit("amount")),
            F.when(F.col("variance").isNotNull(), F.lit("variance applies to periods only")),
        )
    )
    return judged.select(
        F.col("b_id").alias("id"), "check", F.coalesce("suppressed", F.lit(0)).alias("matched"), F.array_join(reasons, "; ").alias("falsified")
    )


def suppress_transactions(suspects: DataFrame, evaluated: DataFrame, benign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suspects left open, and suppressed rows with the first entry that explains them."""
    live = benign.join(evaluated.where("falsified = '' AND matched > 0").select("id"), "id", "left_semi")
    about = _about(suspects, live).where(F.col("b_day").isNull() | (F.col("b_day") == F.col("occurred_on")))
    explained = about.groupBy("id").agg(F.min("b_id").alias("suppressed_by"))
    return suspects.join(explained.select("id"), "id", "left_anti"), suspects.join(explained, "id")


def benign_periods(found: DataFrame, benign: DataFrame, check: str) -> DataFrame:
    """Benign entries of a period-level check: account and period end select, the variance falsifies."""
    entries = benign.where(F.col("check") == check).select(
        "id", "check", F.col("account_id").alias("b_account"), F.col("period_end").alias("b_end"), F.col("variance").alias("b_variance"),
        (F.col("expected_count").isNotNull() | F.col("expected_net").isNotNull() | F.col("amount").isNotNull()).alias("misused"),
    )
    hits = _met(found, entries.select("id", "b_account", "b_end", "b_variance"), (("account_id", "b_account"), ("period_end", "b_end")))
    off = F.col("b_variance").isNotNull() & ~F.col("variance").eqNullSafe(F.col("b_variance"))
    totals = hits.groupBy("id").agg(F.count("*").alias("matched"), F.count_if(off).alias("off"))
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("off", F.lit(0)) > 0, F.lit("variance")), F.when(F.col("misused"), F.lit("applies to rows only"))
        )
    )
    return entries.join(totals, "id", "left").select(
        "id", "check", F.coalesce("matched", F.lit(0)).alias("matched"), F.array_join(reasons, "; ").alias("falsified")
    )


def suppress_periods(found: DataFrame, evaluated: DataFrame, benign: DataFrame) -> DataFrame:
    """Period findings no live entry explains."""
    live = benign.join(evaluated.where("falsified = '' AND matched > 0").select("id"), "id", "left_semi")
    numbered = found.withColumn("_n", F.struct(*[F.col(c) for c in found.columns]))
    entries = live.select(F.col("account_id").alias("b_account"), F.col("period_end").alias("b_end"))
    explained = _met(numbered, entries, (("account_id", "b_account"), ("period_end", "b_end"))).select(F.col("_n").alias("_m")).distinct()
    return numbered.join(explained, F.col("_n").eqNullSafe(F.col("_m")), "left_anti").drop("_n")


def benign_stale(benign: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Entries that are falsified, suppress nothing, or name a check that takes none."""
    joined = benign.select("id", F.col("check").alias("of")).join(evaluated.select("id", "matched", "falsified"), "id", "left")
    problem = (
        F.when(F.col("matched").isNull(), "its check takes no benign entries")
        .when(F.col("falsified") != "", F.concat(F.lit("falsified: "), F.col("falsified")))
        .when(F.col("matched") == 0, "suppresses nothing")
    )
    bad = joined.withColumn("_p", problem).where(F.col("_p").isNotNull())
    return findings(bad, "benign_stale", "warn", F.col("id"), F.col("_p"))


def disposition_metrics(ledger: DataFrame, unpaired: DataFrame) -> DataFrame:
    """Transfer groups, grouped rows and unpaired rows by disposition, per household."""
    names = ("groups", "grouped_rows", "unpaired_rows", "balanced_cluster", "orphan")
    grouped = ledger.groupBy(*HOUSEHOLD).agg(
        F.count_distinct("transfer_group_key").alias("groups"), F.count("transfer_group_key").alias("grouped_rows")
    )
    loose = unpaired.groupBy(*HOUSEHOLD).agg(
        F.count("*").alias("unpaired_rows"), F.count_if("in_cluster").alias("balanced_cluster"), F.count_if(~F.col("in_cluster")).alias("orphan")
    )
    both = grouped.unionByName(loose, allowMissingColumns=True)
    return both.groupBy(*HOUSEHOLD).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])

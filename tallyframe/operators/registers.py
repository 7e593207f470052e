"""Check register and deposit ledger: sidecar entries matched to postings, written as overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.session import cut_lineage

# Match windows in days and description forms.
CHECK_FALLBACK_DAYS = 10
DEPOSIT_DAYS = 3
CHECK_TEXT = r"(?i)^CHECK#"
CHECK_NUMBER = r"(?i)^CHECK#\s*(\S.*?)\s*$"
DEPOSIT_TEXT = r"(?i)^\s*MOBILE\s+CHECK\s+DEP(?:OSIT)?\s*$"

CHECK_REQUIRED = ("account", "check_number", "date_written", "amount", "payee")
DEPOSIT_REQUIRED = ("account", "date_deposited", "amount", "source")


def resolve_label(rows: DataFrame, accounts: DataFrame, label: str = "account") -> DataFrame:
    """``account_id`` from an id or a case-insensitive account name; of both, the first by name."""
    text = F.trim(F.col(label))
    by_id = accounts.select(F.col("account_id").alias("_id_label"), F.struct("account_name", "account_id").alias("_by_id"))
    by_name = accounts.groupBy(F.lower(F.trim("account_name")).alias("_name_label")).agg(
        F.min(F.struct("account_name", "account_id")).alias("_by_name")
    )
    return (
        rows.withColumn("_id_label", text)
        .withColumn("_name_label", F.lower(text))
        .join(by_id, "_id_label", "left")
        .join(by_name, "_name_label", "left")
        .withColumn("account_id", F.least("_by_id", "_by_name")["account_id"])
        .drop("_id_label", "_name_label", "_by_id", "_by_name")
    )


def resolve_alias(rows: DataFrame, accounts: DataFrame, label: str = "account") -> DataFrame:
    """``account_id`` from an id, else from an institution alias that names exactly one account."""
    ids = accounts.select(F.col("account_id").alias("_label"), F.col("account_id").alias("_by_id"))
    aliases = accounts.groupBy(S.squash("institution").alias("_alias")).agg(
        F.count("*").alias("_n"), F.min("account_id").alias("_one")
    )
    joined = (
        rows.withColumn("_label", F.col(label))
        .withColumn("_alias", S.squash(label))
        .join(ids, "_label", "left")
        .join(aliases, "_alias", "left")
    )
    found = F.coalesce(F.col("_by_id"), F.when(F.col("_n") == 1, F.col("_one")))
    error = F.when(found.isNull(), F.when(F.col("_n") > 1, "ambiguous_alias").otherwise("unknown_account"))
    return joined.withColumn("account_id", found).withColumn("resolve_error", error).drop(
        "_label", "_alias", "_by_id", "_n", "_one"
    )


def lookup_config(accounts: DataFrame, config: DataFrame, values: Sequence[str]) -> DataFrame:
    """Config values per account: an entry keyed by its id, else by its lower-cased institution."""
    by_id = config.select(F.col("key").alias("account_id"), F.struct(*values).alias("_by_id"))
    by_name = config.select(F.col("key").alias("_inst"), F.struct(*values).alias("_by_name"))
    return (
        accounts.withColumn("_inst", F.lower(F.trim("institution")))
        .join(by_id, "account_id", "left")
        .join(by_name, "_inst", "left")
        .withColumn("_found", F.coalesce("_by_id", "_by_name"))
        .select(*accounts.columns, *[F.col("_found")[v].alias(v) for v in values])
    )


def _no_zeros(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"^0+", "")


def _day_key(day: Column) -> Column:
    return F.concat(F.lit("d"), F.unix_date(day).cast("string"))


def match_checks(entries: DataFrame, ledger: DataFrame, days: int = CHECK_FALLBACK_DAYS) -> DataFrame:
    """Match each entry (``entry_id``, account_id, check_number, abs_cents, date_written).

    Strict: account, amount and check number. Otherwise any check of that account and
    amount within ``days``. A posting is filed under its number and under its day, an entry
    asks for its number and for every day in reach: one equi-join finds both kinds of hit,
    and one aggregation tells them apart. Postings are counted per key before they meet the
    entries, so nothing is paired row by row; exactly one hit is a match.
    """
    number = F.regexp_extract("description_raw", CHECK_NUMBER, 1)
    by_number = F.struct(F.concat(F.lit("n"), _no_zeros(number)).alias("key"), F.length(number).alias("width"))
    by_day = F.struct(_day_key(F.coalesce("posted_on", "occurred_on")).alias("key"), F.lit(None).cast("int").alias("width"))
    filed = (
        ledger.where(F.col("description_raw").rlike(CHECK_TEXT))
        .select("account_id", "id", F.abs(S.cents("amount")).alias("abs_cents"), F.explode(F.array(by_number, by_day)).alias("filed"))
        .groupBy("account_id", "abs_cents", "filed.key", "filed.width")
        .agg(F.count("*").alias("n"), F.min("id").alias("one"))
    )
    wanted = F.trim("check_number")
    reach = F.sequence(F.date_sub("date_written", days), F.date_add("date_written", days))
    keys = F.concat(F.array(F.concat(F.lit("n"), _no_zeros(wanted))), F.coalesce(F.transform(reach, _day_key), F.array().cast("array<string>")))
    asked = entries.select("entry_id", "account_id", "abs_cents", F.length(wanted).alias("least"), F.explode(keys).alias("key"))
    strict = F.col("width").isNotNull()
    hits = (
        asked.join(filed, ["account_id", "abs_cents", "key"])
        .where(~strict | (F.col("width") >= F.col("least")))
        .groupBy("entry_id")
        .agg(
            F.sum(F.when(strict, F.col("n"))).alias("strict_count"), F.min(F.when(strict, F.col("one"))).alias("strict_id"),
            F.sum(F.when(~strict, F.col("n"))).alias("near_count"), F.min(F.when(~strict, F.col("one"))).alias("near_id"),
        )
    )
    joined = entries.join(hits, "entry_id", "left")
    is_strict = F.coalesce("strict_count", F.lit(0)) > 0
    count = F.when(is_strict, F.col("strict_count")).otherwise(F.coalesce("near_count", F.lit(0)))
    one = F.when(is_strict, F.col("strict_id")).otherwise(F.col("near_id"))
    return _tiered(joined, count, one, F.when(is_strict, "strict").otherwise("window"), "ambiguous_fallback")


def match_deposits(entries: DataFrame, ledger: DataFrame, days: int = DEPOSIT_DAYS) -> DataFrame:
    """Match each deposit entry to a mobile-deposit posting of its account and amount within ``days``."""
    deposits = ledger.where(F.col("description_raw").rlike(DEPOSIT_TEXT)).select(
        "account_id", "id", F.abs(S.cents("amount")).alias("abs_cents"), F.col("occurred_on").alias("day")
    )
    joined = entries.join(_window_hits(entries, deposits, "date_deposited", days), "entry_id", "left")
    return _tiered(joined, F.coalesce("near_count", F.lit(0)), F.col("near_id"), F.lit("window"), "ambiguous_match")


def _window_hits(entries: DataFrame, postings: DataFrame, day: str, days: int) -> DataFrame:
    """Postings of an entry's account and amount within ``days`` of its date: count and one id."""
    per_day = postings.groupBy("account_id", "abs_cents", "day").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    reach = F.sequence(F.date_sub(F.col(day), days), F.date_add(F.col(day), days))
    asked = entries.select("entry_id", "account_id", "abs_cents", F.explode(reach).alias("day"))
    return (
        asked.join(per_day, ["account_id", "abs_cents", "day"])
        .groupBy("entry_id")
        .agg(F.sum("n").alias("near_count"), F.min("one").alias("near_id"))
    )


def _tiered(df: DataFrame, count: Column, one: Column, tier: Column, ambiguous: str) -> DataFrame:
    matched = df.withColumn("candidate_count", count.cast("bigint")).withColumn("_one", one).withColumn("_tier", tier)
    outcome = F.when(F.col("candidate_count") == 1, "matched").when(F.col("candidate_count") > 1, ambiguous).otherwise(
        "no_matching_transaction"
    )
    return (
        matched.withColumn("outcome", outcome)
        .withColumn("transaction_id", F.when(F.col("candidate_count") == 1, F.col("_one")))
        .withColumn("tier", F.when(F.col("candidate_count") == 1, F.col("_tier")))
        .drop("_one", "_tier", "strict_count", "strict_id", "near_count", "near_id")
    )


def _prepare(entries: DataFrame, accounts: DataFrame, required: Sequence[str], key: Sequence[Column], day: str) -> DataFrame:
    """Entries with a ``problem`` (missing value, duplicate, unknown account, parse error) or typed fields."""
    trimmed = entries.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c != "entry_id" else F.col(c) for c in entries.columns])
    missing = F.lit(False)
    for name in required:
        missing = missing | (F.col(name) == "")
    marked = trimmed.withColumn("_dup_key", F.concat_ws("|", *key))
    repeats = marked.groupBy("_dup_key").agg(F.count("*").alias("_copies"))
    resolved = resolve_label(marked.join(repeats, "_dup_key"), accounts)
    amount, parsed = S.money("amount"), S.iso_date(day)
    problem = (
        F.when(missing, "missing_value")
        .when(F.col("_copies") > 1, "duplicate")
        .when(F.col("account_id").isNull(), "unknown_account")
        .when(amount.isNull() | parsed.isNull(), "parse_error")
    )
    return (
        resolved.withColumn("problem", problem)
        .withColumn("abs_cents", F.abs(S.cents(amount)))
        .withColumn(day, parsed)
        .drop("_dup_key", "_copies")
    )


def check_register(entries: DataFrame, accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Outcome of every check register entry (``entry_id`` plus the text columns of the file).

    Prepared entries and outcomes are settled, as both are read more than once: the ledger is
    scanned once for all matches.
    """
    key = [F.lower("account"), F.col("check_number")]
    ready = cut_lineage(_prepare(entries, accounts, CHECK_REQUIRED, key, "date_written"))
    return cut_lineage(_outcomes(ready, match_checks(ready.where(F.col("problem").isNull()), ledger)))


def deposit_ledger(entries: DataFrame, accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Outcome of every deposit ledger entry."""
    key = [F.lower("account"), F.col("date_deposited"), F.col("amount")]
    ready = cut_lineage(_prepare(entries, accounts, DEPOSIT_REQUIRED, key, "date_deposited"))
    return cut_lineage(_outcomes(ready, match_deposits(ready.where(F.col("problem").isNull()), ledger)))


def _outcomes(ready: DataFrame, matched: DataFrame) -> DataFrame:
    found = matched.select("entry_id", F.col("outcome").alias("_o"), "transaction_id", "tier", "candidate_count")
    return (
        ready.join(found, "entry_id", "left")
        .withColumn("outcome", F.coalesce("problem", "_o"))
        .withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)).cast("bigint"))
        .drop("problem", "_o")
    )


def register_overrides(outcomes: DataFrame, ledger: DataFrame, overrides: DataFrame, *, kind: str) -> DataFrame:
    """Override requests for the matched entries; ``superseded`` marks rows that already had one.

    A deposit without a category is income. A request that leaves a field blank keeps it.
    """
    from tallyframe.operators.overrides import override_requests

    payee = "payee" if kind == "check" else "source"
    matched = outcomes.where("outcome = 'matched'").drop("account_id", "amount").withColumnRenamed("transaction_id", "id")
    labels = {c: f"_{c}" for c in ("primary_category", "subcategory", "household_role", "lifecycle", "source") if c in matched.columns}
    rows = ledger.select("id", "account_id", "occurred_on", "amount", "description_raw").join(matched.withColumnsRenamed(labels), "id")

    def given(name: str) -> Column:
        column = F.col(labels[name]) if name in labels else F.lit(None).cast("string")
        return F.when(F.coalesce(column, F.lit("")) != "", column)

    named = F.col(labels.get(payee, payee))
    lead = F.concat(F.lit("Check #"), F.col("check_number"), F.lit(" to "), named) if kind == "check" else F.concat(F.lit("Mobile check deposit from "), named)
    extra = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit(" - "), F.col("notes"))).otherwise("") if "notes" in matched.columns else F.lit("")
    note = F.concat(lead, extra, F.lit(" [register entry "), F.col("entry_id").cast("string"), F.lit("]"))
    category = given("primary_category")
    if kind == "deposit":
        category = F.coalesce(category, F.lit("income"))
    requests = override_requests(
        rows,
        merchant_normalized=named,
        primary_category=category,
        subcategory=given("subcategory"),
        household_role=given("household_role"),
        lifecycle=given("lifecycle"),
        note=note,
    )
    known = overrides.select("match_key", F.lit(True).alias("_known")).distinct()
    return requests.join(known, "match_key", "left").withColumn("superseded", F.coalesce("_known", F.lit(False))).drop("_known")

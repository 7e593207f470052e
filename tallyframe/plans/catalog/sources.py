"""Statement layouts, scalar expressions, routing, upserts and restore plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators import maintenance
from tallyframe.plans.catalog.summaries import MERCHANT_SQL, doubles
from tallyframe.plans.registry import ORACLES, query
from tallyframe.session import cut_lineage
from tallyframe.sources import layouts, routing, store
from tallyframe.sources import sample_ledger as L


def _n() -> Column:
    return F.substring("id", 2, L.ID_WIDTH).cast("bigint")


def _base(spark: SparkSession, d: str) -> DataFrame:
    return L.orders_ledger(spark, d, household=False).withColumn("n", _n())


def _us(day: Column) -> Column:
    return F.date_format(day, "M/d/yyyy")


def _dollar(amount: Column) -> Column:
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(amount), 2))


PARSED_COLUMNS = [
    "row_status", "row_reason", "account_id", "source_record_key", "source_document_name", "occurred_on", "posted_on",
    "description_raw", "amount", "direction", "statement_period",
]


def _shown(rows: DataFrame) -> DataFrame:
    return doubles(rows.select(*PARSED_COLUMNS), "amount")


def card_a_raw(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    n, day = F.col("n"), F.col("occurred_on")
    micro = n % 10 == 5
    day = F.when(micro, F.trunc("occurred_on", "month")).otherwise(day)
    amount = F.when(micro, F.lit("-1.50").cast("decimal(18,2)")).otherwise(F.col("amount"))
    return (_base(spark, d) if base is None else base).select(
        F.when(n % 37 == 0, "").when(n % 41 == 0, "13/45/2020").when(n % 2 == 0, _us(day)).otherwise(F.date_format(day, "MM/dd/yy")).alias("transaction_date"),
        F.coalesce(_us(F.col("posted_on")), F.lit("")).alias("post_date"),
        F.when(n % 43 == 0, "").when(micro, "MICRO  CHARGE").otherwise(F.col("description_raw")).alias("description"),
        F.when(n % 47 == 0, "abc").when(n % 3 == 0, _dollar(amount)).otherwise(amount.cast("string")).alias("amount"),
        F.when(F.col("direction") == "transfer", "Payment").otherwise("Sale").alias("type"),
        F.lit("").alias("category"), F.lit(" ").alias("memo"),
        F.concat(F.date_format("occurred_on", "yyyy-MM"), F.lit("_Card.csv")).alias("source_document_name"),
    )


CARD_A_SQL = """
r AS (
  SELECT n, CASE WHEN n % 10 = 5 THEN CAST(date_trunc('month', occurred_on) AS DATE) ELSE occurred_on END AS day, posted_on,
    CASE WHEN n % 10 = 5 THEN 'MICRO  CHARGE' ELSE description_raw END AS ds, CASE WHEN n % 10 = 5 THEN CAST(-1.50 AS DECIMAL(18,2)) ELSE amount END AS am,
    direction = 'transfer' AS pay, strftime(occurred_on, '%Y-%m') AS ym FROM ol),
s AS (
  SELECT *, CASE WHEN n % 37 = 0 THEN 'skipped' WHEN n % 41 = 0 OR n % 43 = 0 OR n % 47 = 0 THEN 'error' ELSE 'parsed' END AS st,
    CASE WHEN n % 37 = 0 THEN 'pending' WHEN n % 41 = 0 THEN 'unparseable transaction date' WHEN n % 43 = 0 THEN 'description is empty'
      WHEN n % 47 = 0 THEN 'amount is empty or unparseable' END AS rs,
    CASE WHEN pay THEN 'transfer' WHEN am < 0 THEN 'outflow' ELSE 'inflow' END AS dr FROM r),
k AS (
  SELECT *, CAST(day AS VARCHAR) || '|' || CAST(am AS VARCHAR) || '|' || trim(regexp_replace(ds, '\\s+', ' ', 'g')) AS pl FROM s),
o AS (
  SELECT *, row_number() OVER (PARTITION BY ym, st, pl ORDER BY n) - 1 AS sq FROM k),
pa AS (
  SELECT st AS row_status, rs AS row_reason, CASE WHEN st = 'parsed' THEN 'acct-chase-credit-card' END AS account_id,
    CASE WHEN st = 'parsed' THEN substr(sha256(pl || CASE WHEN sq > 0 THEN '|seq' || CAST(sq AS VARCHAR) ELSE '' END), 1, 16) END AS source_record_key,
    ym || '_Card.csv' AS source_document_name, CASE WHEN st = 'parsed' THEN day END AS occurred_on, CASE WHEN st = 'parsed' THEN posted_on END AS posted_on,
    CASE WHEN st = 'parsed' THEN ds END AS description_raw, CAST(CASE WHEN st = 'parsed' THEN CASE dr WHEN 'outflow' THEN -abs(am) WHEN 'inflow' THEN abs(am)
      ELSE am END END AS DOUBLE) AS amount, CASE WHEN st = 'parsed' THEN dr END AS direction, CASE WHEN ym >= '2000' THEN ym END AS statement_period, pl, sq, n FROM o)"""


@query("src2_card_layout_a", "ol", f"WITH {CARD_A_SQL} SELECT * EXCLUDE (pl, sq, n, source_record_key, posted_on, direction, amount, description_raw) FROM pa")
def card_a(spark: SparkSession, d: str) -> DataFrame:
    rows = layouts.parse(card_a_raw(spark, d), layouts.CARD_A)
    return rows.select("row_status", "row_reason", "account_id", "source_document_name", "occurred_on", "statement_period")


@query("src2_card_layout_a_rows", "ol", f"""
WITH {CARD_A_SQL} SELECT occurred_on, posted_on, description_raw, amount, direction FROM pa WHERE row_status = 'parsed'
""")
def card_a_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = layouts.parse(card_a_raw(spark, d), layouts.CARD_A).where("row_status = 'parsed'")
    return doubles(rows.select("occurred_on", "posted_on", "description_raw", "amount", "direction"), "amount")


@query("win1_duplicate_ordinal", "ol", f"WITH {CARD_A_SQL} SELECT source_document_name, source_record_key FROM pa WHERE row_status = 'parsed'")
def duplicate_ordinal(spark: SparkSession, d: str) -> DataFrame:
    rows = layouts.parse(card_a_raw(spark, d), layouts.CARD_A).where("row_status = 'parsed'")
    return rows.select("source_document_name", "source_record_key")


def checking_a_raw(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    n = F.col("n")
    return (_base(spark, d) if base is None else base).select(
        F.when(n % 31 == 0, "").when(n % 2 == 0, F.concat(F.col("occurred_on").cast("string"), F.lit("T04:00:00+00:00"))).otherwise(F.col("occurred_on").cast("string")).alias("posted_date"),
        F.lit("DEBIT").alias("type"), F.lit("short").alias("description"),
        F.when(n % 3 == 0, _dollar(F.col("amount"))).otherwise(F.col("amount").cast("string")).alias("amount"),
        F.concat(F.lit("CK"), (n % 5).cast("string")).alias("account"), F.lit("").alias("notes"),
        F.when(n % 29 == 0, "").otherwise((F.col("amount") * 2).cast("decimal(18,2)").cast("string")).alias("balance"),
        F.when(n % 11 == 0, "ALLY BANK $TRANSFER 123").when(n % 13 == 0, "Chase  Credit Crd").otherwise(F.col("description_raw")).alias("raw_description"),
        F.concat(F.date_format("occurred_on", "yyyy_M"), F.lit("_Checking.csv")).alias("source_document_name"),
    )


@query("src3_checking_layout_a", "ol", """
WITH s AS (
  SELECT *, CASE WHEN n % 31 = 0 THEN 'skipped' WHEN n % 29 = 0 THEN 'error' ELSE 'parsed' END AS st,
    CASE WHEN n % 31 = 0 THEN 'pending' WHEN n % 29 = 0 THEN 'balance is empty or unparseable' END AS rs,
    CASE WHEN n % 11 = 0 THEN 'ALLY BANK $TRANSFER 123' WHEN n % 13 = 0 THEN 'Chase  Credit Crd' ELSE description_raw END AS ds,
    CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN 'transfer' WHEN amount < 0 THEN 'outflow' ELSE 'inflow' END AS dr FROM ol)
SELECT st AS row_status, rs AS row_reason, CASE WHEN st = 'parsed' THEN 'acct-beacon-ck' || CAST(n % 5 AS VARCHAR) END AS account_id,
  CASE WHEN st = 'parsed' THEN substr(sha256(CAST(occurred_on AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|' || trim(regexp_replace(ds, '\\s+', ' ', 'g'))
    || '|' || CAST(CAST(amount * 2 AS DECIMAL(18,2)) AS VARCHAR)), 1, 16) END AS source_record_key,
  strftime(occurred_on, '%Y_') || CAST(month(occurred_on) AS VARCHAR) || '_Checking.csv' AS source_document_name,
  CASE WHEN st = 'parsed' THEN occurred_on END AS occurred_on, CASE WHEN st = 'parsed' THEN occurred_on END AS posted_on,
  CASE WHEN st = 'parsed' THEN ds END AS description_raw, CAST(CASE WHEN st = 'parsed' THEN amount END AS DOUBLE) AS amount,
  CASE WHEN st = 'parsed' THEN dr END AS direction, CASE WHEN year(occurred_on) >= 2000 THEN strftime(occurred_on, '%Y-%m') END AS statement_period FROM s
""")
def checking_a(spark: SparkSession, d: str) -> DataFrame:
    return _shown(layouts.parse(checking_a_raw(spark, d), layouts.CHECKING_A))


def savings_a_raw(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    n = F.col("n")
    minute = F.lpad((n % 60).cast("string"), 2, "0")
    return (_base(spark, d) if base is None else base).select(
        F.when(n % 23 == 0, "").when(n % 5 == 0, F.col("occurred_on").cast("string")).otherwise(_us(F.col("occurred_on"))).alias("date"),
        F.when(n % 19 == 0, "25:00").when(n % 2 == 0, F.concat(F.lit("9:"), minute)).otherwise(F.concat(F.lit("13:"), minute, F.lit(":07"))).alias("time"),
        F.col("amount").cast("string").alias("amount"), F.lit("Deposit").alias("type"),
        F.when(n % 7 == 0, "Requested transfer from OUTSIDE").when(n % 11 == 0, "requested  transfer to CHECKING").otherwise(F.col("description_raw")).alias("description"),
        F.lit("2026-13_Savings.csv").alias("source_document_name"),
    )


@query("src4_savings_layout_a", "ol", """
WITH s AS (
  SELECT *, CASE WHEN n % 23 = 0 THEN 'skipped' WHEN n % 19 = 0 THEN 'error' ELSE 'parsed' END AS st,
    CASE WHEN n % 23 = 0 THEN 'missing_date' WHEN n % 19 = 0 THEN 'unparseable time' END AS rs,
    CASE WHEN n % 7 = 0 THEN 'Requested transfer from OUTSIDE' WHEN n % 11 = 0 THEN 'requested  transfer to CHECKING' ELSE description_raw END AS ds,
    CASE WHEN n % 2 = 0 THEN '09:' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || ':00' ELSE '13:' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || ':07' END AS tm,
    CASE WHEN n % 7 = 0 OR n % 11 = 0 THEN 'transfer' WHEN amount < 0 THEN 'outflow' ELSE 'inflow' END AS dr FROM ol)
SELECT st AS row_status, rs AS row_reason, CASE WHEN st = 'parsed' THEN 'acct-ally-hysa' END AS account_id,
  CASE WHEN st = 'parsed' THEN substr(sha256(CAST(occurred_on AS VARCHAR) || '|' || tm || '|' || CAST(amount AS VARCHAR) || '|'
    || trim(regexp_replace(ds, '\\s+', ' ', 'g'))), 1, 16) END AS source_record_key, '2026-13_Savings.csv' AS source_document_name,
  CASE WHEN st = 'parsed' THEN occurred_on END AS occurred_on, CASE WHEN st = 'parsed' THEN occurred_on END AS posted_on,
  CASE WHEN st = 'parsed' THEN ds END AS description_raw, CAST(CASE WHEN st = 'parsed' THEN amount END AS DOUBLE) AS amount,
  CASE WHEN st = 'parsed' THEN dr END AS direction, CAST(NULL AS VARCHAR) AS statement_period FROM s
""")
def savings_a(spark: SparkSession, d: str) -> DataFrame:
    return _shown(layouts.parse(savings_a_raw(spark, d), layouts.SAVINGS_A))


def checking_b_raw(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    n, a = F.col("n"), F.col("amount")
    shown = a.cast("string")
    return (_base(spark, d) if base is None else base).select(
        F.when(n % 31 == 0, "").otherwise(_us(F.col("occurred_on"))).alias("date"), F.lit("POS").alias("type"),
        F.when(n % 11 == 0, "CHASE CREDIT CRD EPAY").otherwise(F.col("description_raw")).alias("description"),
        F.when(n % 29 == 0, "").when(n % 37 == 0, shown).when((a < 0) | (n % 41 == 0), shown).otherwise("").alias("debit"),
        F.when(n % 29 == 0, "").when(n % 37 == 0, "0.00").when(n % 41 == 0, "12.00").when(a >= 0, shown).otherwise("").alias("credit"),
        F.lit("77.10").alias("balance"), F.lit("r1").alias("referenceno"),
        F.concat(F.lit("Statement 20"), F.lit("26-1.csv")).alias("source_document_name"),
    )


@query("src5_checking_layout_b", "ol", """
WITH s AS (
  SELECT *, CASE WHEN n % 31 = 0 THEN 'skipped' WHEN n % 29 = 0 OR (n % 41 = 0 AND n % 37 <> 0) THEN 'error' ELSE 'parsed' END AS st,
    CASE WHEN n % 31 = 0 THEN 'missing_date' WHEN n % 29 = 0 OR (n % 41 = 0 AND n % 37 <> 0) THEN 'debit and credit are both empty or unparseable' END AS rs,
    CASE WHEN n % 11 = 0 THEN 'CHASE CREDIT CRD EPAY' ELSE description_raw END AS ds,
    CASE WHEN n % 11 = 0 THEN 'transfer' WHEN amount < 0 THEN 'outflow' ELSE 'inflow' END AS dr FROM ol)
SELECT st AS row_status, rs AS row_reason, CASE WHEN st = 'parsed' THEN 'acct-webster-checking' END AS account_id,
  CASE WHEN st = 'parsed' THEN substr(sha256(CAST(occurred_on AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|'
    || trim(regexp_replace(ds, '\\s+', ' ', 'g')) || '|77.10'), 1, 16) END AS source_record_key, 'Statement 2026-1.csv' AS source_document_name,
  CASE WHEN st = 'parsed' THEN occurred_on END AS occurred_on, CASE WHEN st = 'parsed' THEN occurred_on END AS posted_on,
  CASE WHEN st = 'parsed' THEN ds END AS description_raw, CAST(CASE WHEN st = 'parsed' THEN amount END AS DOUBLE) AS amount,
  CASE WHEN st = 'parsed' THEN dr END AS direction, '2026-01' AS statement_period FROM s
""")
def checking_b(spark: SparkSession, d: str) -> DataFrame:
    return _shown(layouts.parse(checking_b_raw(spark, d), layouts.CHECKING_B))


def card_b_raw(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    n = F.col("n")
    size = F.abs("amount").cast("string")
    charge = F.col("direction") == "outflow"
    return (_base(spark, d) if base is None else base).select(
        F.when(n % 23 == 0, "Pending").when(n % 2 == 0, " Cleared ").otherwise("posted").alias("status"), _us(F.col("occurred_on")).alias("date"),
        F.when(n % 9 == 0, "THANK YOU AUTO-PMT").otherwise(F.col("description_raw")).alias("description"),
        F.when(n % 29 == 0, "").when(charge | (n % 31 == 0), size).otherwise("").alias("debit"),
        F.when(n % 29 == 0, "").when(~charge | (n % 31 == 0), F.concat(F.lit("-"), size)).otherwise("").alias("credit"),
        F.concat(F.col("id"), F.lit(".csv")).alias("source_document_name"),
    )


@query("src6_card_layout_b", "ol", """
WITH s AS (
  SELECT *, CASE WHEN n % 23 = 0 THEN 'skipped' WHEN n % 29 = 0 OR n % 31 = 0 THEN 'error' ELSE 'parsed' END AS st,
    CASE WHEN n % 23 = 0 THEN 'pending' WHEN n % 29 = 0 THEN 'both debit and credit are empty or unparseable'
      WHEN n % 31 = 0 THEN 'both debit and credit are populated' END AS rs,
    CASE WHEN n % 9 = 0 THEN 'THANK YOU AUTO-PMT' ELSE description_raw END AS ds, CASE direction WHEN 'outflow' THEN -abs(amount) ELSE abs(amount) END AS am,
    CASE WHEN direction = 'outflow' THEN 'outflow' WHEN n % 9 = 0 THEN 'transfer' ELSE 'inflow' END AS dr FROM ol)
SELECT st AS row_status, rs AS row_reason, CASE WHEN st = 'parsed' THEN 'acct-citi-credit-card' END AS account_id,
  CASE WHEN st = 'parsed' THEN substr(sha256(CAST(occurred_on AS VARCHAR) || '|' || CAST(am AS VARCHAR) || '|'
    || trim(regexp_replace(ds, '\\s+', ' ', 'g'))), 1, 16) END AS source_record_key, id || '.csv' AS source_document_name,
  CASE WHEN st = 'parsed' THEN occurred_on END AS occurred_on, CASE WHEN st = 'parsed' THEN occurred_on END AS posted_on,
  CASE WHEN st = 'parsed' THEN ds END AS description_raw, CAST(CASE WHEN st = 'parsed' THEN am END AS DOUBLE) AS amount,
  CASE WHEN st = 'parsed' THEN dr END AS direction, CAST(NULL AS VARCHAR) AS statement_period FROM s
""")
def card_b(spark: SparkSession, d: str) -> DataFrame:
    return _shown(layouts.parse(card_b_raw(spark, d), layouts.CARD_B))


def savings_b_raw(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    n = F.col("n")
    return (_base(spark, d) if base is None else base).select(
        F.when(n % 31 == 0, "").when(n % 29 == 0, F.date_format("occurred_on", "M/d/yy")).otherwise(_us(F.col("occurred_on"))).alias("date"),
        F.when(n % 3 == 0, "").when(n % 11 == 0, "ALLY BANK $TRANSFER").otherwise(F.col("description_raw")).alias("description"),
        F.when(n % 33 == 0, "").otherwise("Share Deposit").alias("ext"), F.lit("").alias("draft"),
        F.regexp_replace(F.col("amount").cast("string"), r"^(-?)0\.", "$1.").alias("amount"),
        (F.col("amount") + n).cast("decimal(18,2)").cast("string").alias("balance"),
        F.concat(F.col("id"), F.lit(".csv")).alias("source_document_name"),
    )


@query("src7_savings_layout_b", "ol", """
WITH s AS (
  SELECT *, CASE WHEN n % 3 = 0 THEN CASE WHEN n % 33 = 0 THEN '' ELSE 'Share Deposit' END WHEN n % 11 = 0 THEN 'ALLY BANK $TRANSFER | Share Deposit'
      ELSE description_raw || ' | Share Deposit' END AS ds FROM ol),
t AS (
  SELECT *, CASE WHEN n % 31 = 0 THEN 'skipped' WHEN n % 29 = 0 OR ds = '' THEN 'error' ELSE 'parsed' END AS st,
    CASE WHEN n % 31 = 0 THEN 'missing_date' WHEN n % 29 = 0 THEN 'unparseable date' WHEN ds = '' THEN 'row has neither a description nor an ext value' END AS rs,
    CASE WHEN n % 11 = 0 AND n % 3 <> 0 THEN 'transfer' WHEN amount < 0 THEN 'outflow' ELSE 'inflow' END AS dr FROM s)
SELECT st AS row_status, rs AS row_reason, CASE WHEN st = 'parsed' THEN 'acct-selfhelp-savings' END AS account_id,
  CASE WHEN st = 'parsed' THEN substr(sha256(CAST(occurred_on AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|'
    || CAST(CAST(amount + n AS DECIMAL(18,2)) AS VARCHAR)), 1, 16) END AS source_record_key, id || '.csv' AS source_document_name,
  CASE WHEN st = 'parsed' THEN occurred_on END AS occurred_on, CASE WHEN st = 'parsed' THEN occurred_on END AS posted_on,
  CASE WHEN st = 'parsed' THEN ds END AS description_raw, CAST(CASE WHEN st = 'parsed' THEN amount END AS DOUBLE) AS amount,
  CASE WHEN st = 'parsed' THEN dr END AS direction, CAST(NULL AS VARCHAR) AS statement_period FROM t
""")
def savings_b(spark: SparkSession, d: str) -> DataFrame:
    return _shown(layouts.parse(savings_b_raw(spark, d), layouts.SAVINGS_B))


@query("src8_row_channels", "ol", f"WITH {CARD_A_SQL} SELECT row_status, coalesce(row_reason, '') AS row_reason, count(*) AS n FROM pa GROUP BY 1, 2")
def row_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = layouts.parse(card_a_raw(spark, d), layouts.CARD_A)
    bad = layouts.quarantined_rows(rows).groupBy("row_status", "row_reason").agg(F.count("*").alias("n"))
    good = layouts.parsed_rows(rows).agg(F.count("*").alias("n")).select(F.lit("parsed").alias("row_status"), F.lit("").alias("row_reason"), "n")
    return good.unionByName(bad)


@query("src9_statement_period", "ol", """
SELECT id, CASE WHEN n % 4 IN (0, 1) AND year(occurred_on) >= 2000 THEN strftime(occurred_on, '%Y-%m') END AS period FROM ol
""")
def periods(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    name = (
        F.when(n % 4 == 0, F.concat(F.date_format("occurred_on", "yyyy-MM"), F.lit("_x.csv")))
        .when(n % 4 == 1, F.concat(F.lit("Card_"), F.date_format("occurred_on", "yyyy_M"), F.lit(".v2.csv")))
        .when(n % 4 == 2, F.lit("all.2026-01"))
        .otherwise(F.lit("x2026-13.csv"))
    )
    return _base(spark, d).select("id", S.statement_period(name).alias("period"))


def _stored_and_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ledger of the first years as the store; a batch of later rows plus re-imports, relabelled."""
    rows = _base(spark, d).drop("n").withColumn("n", _n())
    stored = rows.where("year(occurred_on) < 2000")
    batch = rows.where("year(occurred_on) >= 2000 OR n % 9 = 0").withColumns(
        {"id": F.concat(F.lit("new-"), F.col("id")), "primary_category": F.lit("unclassified"), "source_document_name": F.lit("batch.csv")}
    )
    return stored.drop("n"), store.newest_batch(batch.drop("n"))


@query("src20_ledger_upsert", "ol", """
SELECT CASE WHEN year(occurred_on) < 2000 THEN id ELSE 'new-' || id END AS id, account_id, source_record_key,
  CASE WHEN year(occurred_on) >= 2000 OR n % 9 = 0 THEN 'unclassified' ELSE primary_category END AS primary_category,
  CASE WHEN year(occurred_on) >= 2000 OR n % 9 = 0 THEN 'batch.csv' ELSE source_document_name END AS source_document_name
FROM ol
""")
def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    stored, batch = _stored_and_batch(spark, d)
    return store.upsert(stored, batch).select("id", "account_id", "source_record_key", "primary_category", "source_document_name")


@query("src21_upsert_dry_run", "ol", """
SELECT account_id, count(*) FILTER (year(occurred_on) >= 2000) AS would_insert, count(*) FILTER (year(occurred_on) < 2000) AS would_update
FROM ol WHERE year(occurred_on) >= 2000 OR n % 9 = 0 GROUP BY 1
""")
def upsert_dry_run(spark: SparkSession, d: str) -> DataFrame:
    stored, batch = _stored_and_batch(spark, d)
    return store.upsert_counts(stored, batch)


@query("src22_account_upsert", "ac", """
SELECT account_id, CASE WHEN k % 6 = 0 THEN 'Renamed Bank' ELSE institution END AS institution, account_name FROM ac WHERE k % 2 = 0 OR k % 6 = 0 OR k % 3 = 1
""")
def account_upsert(spark: SparkSession, d: str) -> DataFrame:
    accounts = L.accounts(spark, d)
    k = F.substring("account_id", 6, L.ID_WIDTH).cast("bigint")
    stored = accounts.where((k % 2 == 0) | (k % 3 == 1))
    old, new = accounts.where(k % 6 == 0).withColumn("at", F.lit(1)), accounts.where(k % 6 == 0).withColumn("at", F.lit(2))
    found = old.withColumn("institution", F.lit("Old Bank")).unionByName(new.withColumn("institution", F.lit("Renamed Bank")))
    return store.upsert_accounts(stored, found, "at").select("account_id", "institution", "account_name")


@query("src24_restore_plan", "ol ov", """
SELECT match_key, CASE WHEN n % 84 = 0 THEN 'insert' WHEN n % 132 = 0 THEN 'not_in_export' WHEN n % 24 = 0 THEN 'update' ELSE 'unchanged' END AS action,
  CASE WHEN n % 84 <> 0 AND n % 132 <> 0 AND n % 24 = 0 THEN 'merchant_normalized,note' END AS changed FROM ov
""")
def restore_plan(spark: SparkSession, d: str) -> DataFrame:
    """Stored overrides and an export of them: some rows only on one side, some changed."""
    rows = L.overrides(spark, d).drop("created_at", "updated_at").join(
        _base(spark, d).select("account_id", "occurred_on", "amount", "n").where("n % 12 = 0"), ["account_id", "occurred_on", "amount"]
    )
    stored = rows.where("n % 84 <> 0").drop("n")
    edited = rows.where("n % 132 <> 0 OR n % 84 = 0").withColumns(
        {
            "merchant_normalized": F.when(F.col("n") % 24 == 0, "Edited").otherwise(F.col("merchant_normalized")),
            "note": F.when(F.col("n") % 24 == 0, "edited").otherwise(F.col("note")),
        }
    )
    return store.restore_plan(stored, edited.drop("n"), "match_key")


@query("src15_file_summary", "ol", f"""
WITH {CARD_A_SQL},
kn AS (SELECT DISTINCT source_record_key AS key FROM pa WHERE row_status = 'parsed' AND source_document_name < '1998')
SELECT source_document_name, 'chase-credit-card' AS layout, count(*) FILTER (row_status = 'parsed' AND key IS NULL) AS inserted,
  count(*) FILTER (row_status = 'parsed' AND key IS NOT NULL) AS updated, count(*) FILTER (row_status = 'skipped') AS skipped,
  count(*) FILTER (row_status = 'error') AS errors,
  CASE WHEN count(*) FILTER (row_status = 'parsed') = 0 AND count(*) FILTER (row_status = 'error') > 0 THEN 'error' ELSE 'ingested' END AS status
FROM pa LEFT JOIN kn ON key = source_record_key AND row_status = 'parsed' GROUP BY 1
""")
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = layouts.parse(card_a_raw(spark, d), layouts.CARD_A)
    existing = rows.where("row_status = 'parsed' AND source_document_name < '1998'")
    return layouts.file_summary(rows, existing)


KNOWN_SQL = CARD_A_SQL + """,
kn AS (SELECT DISTINCT source_record_key AS key FROM pa WHERE row_status = 'parsed' AND source_document_name < '1998'),
fs AS (
  SELECT source_document_name, count(*) FILTER (row_status = 'parsed' AND key IS NULL) AS inserted, count(*) FILTER (row_status = 'parsed' AND key IS NOT NULL) AS updated,
    count(*) FILTER (row_status = 'skipped') AS skipped, count(*) FILTER (row_status = 'error') AS errors
  FROM pa LEFT JOIN kn ON key = source_record_key AND row_status = 'parsed' GROUP BY 1)"""


def _filed(spark: SparkSession, d: str) -> DataFrame:
    """Per file, with the files up to 1997 stored by an earlier run."""
    rows = layouts.parse(card_a_raw(spark, d), layouts.CARD_A)
    return layouts.file_summary(rows, rows.where("row_status = 'parsed' AND source_document_name < '1998'"))


@query("src15_run_totals", "ol", f"""
WITH {KNOWN_SQL}
SELECT count(*) AS files_seen, count(*) FILTER (inserted + updated > 0 OR errors = 0) AS files_ingested, CAST(0 AS BIGINT) AS files_without_parser,
  count(*) FILTER (inserted + updated = 0 AND errors > 0) AS files_with_errors, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(updated) AS BIGINT) AS updated,
  CAST(sum(skipped) AS BIGINT) AS skipped FROM fs
""")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return layouts.run_totals(_filed(spark, d))


@query("src19_import_audit", "ol", f"""
WITH {KNOWN_SQL}
SELECT source_document_name AS source_name, 'chase-credit-card' AS layout, inserted + updated AS row_count FROM fs
""")
def import_audit(spark: SparkSession, d: str) -> DataFrame:
    return store.audit_rows(_filed(spark, d), F.lit("2026-01-01 00:00:00").cast("timestamp")).select("source_name", "layout", "row_count")


# --- routing -----------------------------------------------------------------


def part_files(spark: SparkSession, d: str) -> DataFrame:
    """One file per part: brand folder, camel-case part name, key, alternating extension."""
    key = F.col("p_partkey")
    name = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("_"), key.cast("string"))
    ext = F.when(key % 3 == 0, ".csv").when(key % 3 == 1, ".PDF").otherwise(".png")
    return L.table(spark, d, "part").select(F.concat(F.lit("inbox/"), F.col("p_brand"), F.lit("/"), name, ext).alias("path"))


def name_sources(spark: SparkSession, d: str) -> DataFrame:
    """A tracked source per distinct part name and type."""
    rows = L.table(spark, d, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("position"))
    return rows.select(
        F.concat(F.lit("doc-"), F.lpad(F.col("position").cast("string"), 6, "0")).alias("source_id"), "position",
        F.concat(F.element_at(F.array(*[F.lit(c) for c in "ABCDEFGH"]), (F.col("position") % 8 + 1).cast("int")), F.lit(". "), F.initcap("p_type")).alias("category"),
        F.concat("p_name", F.lit(" statement")).alias("document"), F.lower("p_type").alias("subject"), F.lit("the cash history").alias("why_needed"),
        F.when(F.col("position") % 4 == 0, "CSV export").when(F.col("position") % 4 == 1, "PDF invoice").when(F.col("position") % 4 == 2, "Screenshot").otherwise("").alias("format"),
        F.when(F.col("position") % 10 == 0, " Yes ").otherwise("").alias("obtained"),
        F.when(F.col("position") % 3 == 0, "Essential").otherwise("Later").alias("priority"),
    )


ROUTE_SQL = r"""
src AS (
  SELECT 'doc-' || lpad(CAST(position AS VARCHAR), 6, '0') AS source_id, position, p_name || ' statement' AS document,
    substr('ABCDEFGH', CAST(position % 8 + 1 AS INTEGER), 1) || '. ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS category,
    CASE position % 4 WHEN 0 THEN ['csv'] WHEN 1 THEN ['pdf', 'csv'] WHEN 2 THEN ['png', 'jpg', 'jpeg', 'webp'] ELSE [] END AS exts,
    position % 10 = 0 AS flag, position % 3 = 0 AS essential, lower(p_type) AS subject
  FROM (SELECT p_name, p_type, min(p_partkey) AS position FROM part GROUP BY 1, 2) x),
fl AS (
  SELECT 'inbox/' || p_brand || '/' || stem || CASE p_partkey % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.PDF' ELSE '.png' END AS path, stem, p_brand AS parent,
    CASE p_partkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' ELSE 'png' END AS ext
  FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') || '_'
    || CAST(p_partkey AS VARCHAR) AS stem FROM part) x),
stop AS (SELECT ['all', 'and', 'annual', 'export', 'history', 'if', 'in', 'of', 'or', 'pdf', 'screenshot', 'the', 'ytd', '2026', '2027'] AS w),
s2 AS (
  SELECT src.*, list_distinct(list_filter(regexp_extract_all(lower(document || ' ' || category || ' ' || subject || ' the cash history'), '[a-z]+|[0-9]+'),
      lambda t: length(t) > 2 AND NOT list_contains(w, t))) AS toks,
    array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(document), '[a-z]+|[0-9]+'), lambda t: length(t) > 2 AND NOT list_contains(w, t)))), ' ') AS nm
  FROM src, stop),
f2 AS (
  SELECT fl.*, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(stem || ' ' || parent || ' ' || ext, '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z]+|[0-9]+'),
      lambda t: length(t) > 2 AND NOT list_contains(w, t))) AS toks,
    array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(stem, '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z]+|[0-9]+'),
      lambda t: length(t) > 2 AND NOT list_contains(w, t)))), ' ') AS nm
  FROM fl, stop),
s3 AS (SELECT *, list_distinct(list_transform(range(1, length(nm)), lambda i: substr(nm, i, 2))) AS bg FROM s2),
f3 AS (SELECT *, list_distinct(list_transform(range(1, length(nm)), lambda i: substr(nm, i, 2))) AS bg FROM f2),
sc AS (
  SELECT path, source_id, position, CAST(len(list_intersect(s3.toks, f3.toks)) AS DOUBLE) / greatest(len(s3.toks), 1) * CAST(0.65 AS DOUBLE)
    + CAST(len(list_intersect(s3.bg, f3.bg)) * 2 AS DOUBLE) / (len(s3.bg) + len(f3.bg)) * CAST(0.35 AS DOUBLE)
    + CASE WHEN list_contains(exts, ext) THEN CAST(0.15 AS DOUBLE) ELSE 0 END AS score
  FROM f3, s3),
rt AS (
  SELECT fl.path, source_id, score FROM fl LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, position) AS rn FROM sc
    WHERE score >= CAST(0.35 AS DOUBLE)) b ON b.path = fl.path AND rn = 1)"""


@query("src12_file_routing", "", f"WITH {ROUTE_SQL} SELECT path, source_id, round(score, 6) AS score FROM rt")
def file_routing(spark: SparkSession, d: str) -> DataFrame:
    return routing.route_files(part_files(spark, d), name_sources(spark, d)).withColumn("score", F.round("score", 6))


@query("src13_match_scores", "", f"""
WITH {ROUTE_SQL},
p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, path) AS place FROM sc WHERE score >= CAST(0.35 AS DOUBLE))
SELECT source_id, CAST(place AS BIGINT) AS place, path, round(score, 6) AS score FROM p WHERE place <= 3
""")
def match_scores(spark: SparkSession, d: str) -> DataFrame:
    out = routing.top_matches(part_files(spark, d), name_sources(spark, d))
    return out.select("source_id", F.col("place").cast("bigint").alias("place"), "path", F.round("score", 6).alias("score"))


@query("src14_layout_dispatch", "", f"""
WITH {ROUTE_SQL}
SELECT path, rt.source_id, CASE src.position % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'savings' END AS layout,
  CASE WHEN src.position % 3 < 2 THEN 'routed' ELSE 'no_parser' END AS status
FROM rt LEFT JOIN src ON src.source_id = rt.source_id
""")
def layout_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Two of three sources have a layout, however many there are."""
    sources = name_sources(spark, d)
    layout_of = sources.where("position % 3 < 2").select("source_id", F.when(F.col("position") % 3 == 0, "card").otherwise("savings").alias("layout"))
    return routing.dispatch(routing.route_files(part_files(spark, d), sources), layout_of).select("path", "source_id", "layout", "status")


def statement_records(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The statements of each layout as records of text, with their headers as banks write them."""
    raws = (
        (layouts.CARD_A, card_a_raw), (layouts.CHECKING_A, checking_a_raw), (layouts.SAVINGS_A, savings_a_raw),
        (layouts.CHECKING_B, checking_b_raw), (layouts.CARD_B, card_b_raw), (layouts.SAVINGS_B, savings_b_raw),
    )
    # all statements tell of the same postings, which are derived once
    base = cut_lineage(_base(spark, d).select("id", "n", "occurred_on", "posted_on", "direction", "amount", "description_raw"))
    found = {}
    for layout, raw in raws:
        rows = raw(spark, d, base)
        names = [c for c in rows.columns if c != "source_document_name"]
        header = ",".join(n.replace("_", " ").title() for n in names)
        record = F.to_csv(F.struct(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]), {"quote": '"', "escape": '"', "emptyValue": ""})
        found[layout.name] = rows.select(F.lit(header).alias("header"), record.alias("record"), "source_document_name")
    return found


SHARED_COLUMNS = "row_status, row_reason, account_id, source_document_name, occurred_on, posted_on, description_raw, amount, direction, statement_period"


@query("src14_parse_all_layouts", "ol", f"""
WITH {CARD_A_SQL},
every AS (
  SELECT 'chase-credit-card' AS layout, {SHARED_COLUMNS} FROM pa
  UNION ALL SELECT 'beacon-checking', {SHARED_COLUMNS} FROM ({ORACLES["src3_checking_layout_a"]})
  UNION ALL SELECT 'ally-hysa', {SHARED_COLUMNS} FROM ({ORACLES["src4_savings_layout_a"]})
  UNION ALL SELECT 'webster-checking', {SHARED_COLUMNS} FROM ({ORACLES["src5_checking_layout_b"]})
  UNION ALL SELECT 'citi-credit-card', {SHARED_COLUMNS} FROM ({ORACLES["src6_card_layout_b"]})
  UNION ALL SELECT 'selfhelp-savings', {SHARED_COLUMNS} FROM ({ORACLES["src7_savings_layout_b"]}))
SELECT * FROM every
""")
def parse_all_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Six layouts from text: columns by each record's own header, rows by each layout's own rules."""
    rows, _ = routing.parse_records(statement_records(spark, d), list(layouts.LAYOUTS.values()))
    return doubles(rows.select("layout", *SHARED_COLUMNS.split(", ")), "amount")


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    sources = name_sources(spark, d)
    return routing.source_coverage(sources, routing.route_files(part_files(spark, d), sources))


@query("src16_source_coverage", "", f"""
WITH {ROUTE_SQL},
m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, path) AS rn FROM rt WHERE source_id IS NOT NULL)
SELECT src.source_id, count(m.path) AS matched_files, flag OR count(m.path) > 0 AS is_obtained,
  CASE WHEN flag THEN 'tracker' WHEN count(m.path) > 0 THEN 'filesystem' ELSE 'none' END AS obtained_by,
  string_agg(m.path, ',' ORDER BY rn) FILTER (rn <= 3) AS best_paths
FROM src LEFT JOIN m ON m.source_id = src.source_id GROUP BY src.source_id, flag
""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    paths = F.array_join(F.transform("best_files", lambda b: b["path"]), ",")
    return _coverage(spark, d).select("source_id", "matched_files", "is_obtained", "obtained_by", paths.alias("best_paths"))


DISPOSED_SQL = ROUTE_SQL + """,
cv AS (SELECT src.*, substr(category, 1, 1) AS category_id, flag OR EXISTS (SELECT 1 FROM rt WHERE rt.source_id = src.source_id) AS is_obtained FROM src),
ds AS (SELECT *, CASE WHEN category_id IN ('E', 'F') THEN 'deferred_planning' WHEN category_id = 'H' THEN 'not_needed'
    WHEN category_id = 'D' AND regexp_matches(document, 'electric|gas|water') THEN 'not_needed' WHEN is_obtained THEN 'resolved' ELSE 'open' END AS disposition FROM cv)"""


@query("src17_category_coverage", "", f"""
WITH {DISPOSED_SQL}
SELECT category, category_id, count(*) AS total, count(*) FILTER (is_obtained) AS obtained, count(*) FILTER (NOT is_obtained) AS missing FROM ds GROUP BY 1, 2
""")
def category_coverage(spark: SparkSession, d: str) -> DataFrame:
    return routing.category_summary(routing.dispositions(_coverage(spark, d)))


@query("src17_readiness", "", f"""
WITH {DISPOSED_SQL}
SELECT count(*) FILTER (essential) AS essential, count(*) FILTER (essential AND is_obtained) AS essential_ready,
  count(*) FILTER (essential AND NOT is_obtained) AS essential_gap, count(*) FILTER (NOT essential AND NOT is_obtained) AS open_later,
  round(count(*) FILTER (essential AND is_obtained) / count(*) FILTER (essential) * 100, 2) AS readiness_pct
FROM ds WHERE disposition IN ('open', 'resolved')
""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return routing.readiness(routing.dispositions(_coverage(spark, d)))


# --- scalar expressions --------------------------------------------------------


@query("expr1_money_text", "ol", """
SELECT id, CASE WHEN n % 10 = 9 THEN NULL ELSE CAST(amount AS DOUBLE) END AS amount FROM ol
""")
def money_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    shown = F.when(n % 10 == 9, "n/a").when(n % 2 == 0, F.concat(F.lit("  "), _dollar(F.col("amount")))).otherwise(F.col("amount").cast("string"))
    return doubles(_base(spark, d).select("id", S.money(shown).alias("amount")), "amount")


@query("expr2_dates", "ol", "SELECT id, CASE WHEN n % 10 = 9 THEN NULL ELSE occurred_on END AS day FROM ol")
def dates(spark: SparkSession, d: str) -> DataFrame:
    n, day = F.col("n"), F.col("occurred_on")
    shown = (
        F.when(n % 10 == 9, "31/31/1999").when(n % 3 == 0, _us(day)).when(n % 3 == 1, F.date_format(day, "MM/dd/yy")).otherwise(day.cast("string"))
    )
    return _base(spark, d).select("id", S.first_date(S.us_date(shown, True), S.iso_date(shown)).alias("day"))


@query("expr3_times", "", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE strftime(ts, '%H:%M:') || CASE WHEN event_id % 2 = 0 THEN '00' ELSE strftime(ts, '%S') END END AS t
FROM events
""")
def times(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id")
    shown = F.when(key % 9 == 0, "24:61").when(key % 2 == 0, F.date_format("ts", "H:m")).otherwise(F.date_format("ts", "H:m:s"))
    return L.table(spark, d, "events").select("event_id", S.clock_time(shown).alias("t"))


@query("expr4_whitespace", "ol", """
SELECT id, trim(regexp_replace(upper(description_raw), '\\s+', ' ', 'g')) AS collapsed, lower(trim(regexp_replace(description_raw, '\\s+', ' ', 'g'))) AS folded FROM ol
""")
def whitespace(spark: SparkSession, d: str) -> DataFrame:
    wide = F.concat(F.lit(" \t"), F.regexp_replace("description_raw", " ", " \n "), F.lit("  "))
    return _base(spark, d).select("id", S.collapse(F.upper(wide)).alias("collapsed"), S.collapse_lower(wide).alias("folded"))


@query("expr5_direction", "ol", """
SELECT id, CASE WHEN regexp_matches(description_raw, '(?i)ring|check#') THEN 'transfer' WHEN amount < 0 THEN 'outflow' ELSE 'inflow' END AS direction FROM ol
""")
def directions(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select("id", layouts.direction_of(F.col("amount"), F.col("description_raw"), ("RING", "check#")).alias("direction"))


@query("expr6_signed_amount", "ol", "SELECT id, CAST(amount AS DOUBLE) AS amount, CAST(effect AS DOUBLE) AS effect FROM ol")
def signed(spark: SparkSession, d: str) -> DataFrame:
    rows = _base(spark, d)
    given = F.when(F.col("direction") == "transfer", F.col("amount")).otherwise(-F.col("amount"))
    return doubles(rows.select("id", S.signed_amount(given, "direction").alias("amount"), S.posted_effect().alias("effect")), "amount", "effect")


@query("expr7_record_key", "ol", "SELECT id, source_record_key FROM ol")
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select("id", "source_record_key")


@query("expr8_override_key", "ol", """
SELECT id, substr(sha256(account_id || '|' || CAST(occurred_on AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|'
  || lower(trim(regexp_replace(description_raw, '\\s+', ' ', 'g')))), 1, 24) AS match_key FROM ol
""")
def override_keys(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select("id", S.override_key().alias("match_key"))


@query("expr9_metadata", "", """
SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 5 = 0 AS flagged FROM events
""")
def metadata(spark: SparkSession, d: str) -> DataFrame:
    parsed = S.parse_metadata("props")
    flag = F.when(F.col("event_id") % 5 == 0, "true")
    rows = L.table(spark, d, "events").select("event_id", S.merge_metadata(parsed, {"manual_override_applied": flag}).alias("m"))
    return rows.select("event_id", S.metadata_field("m", "k").alias("k"), S.is_flagged("m").alias("flagged"))


@query("expr10_merchant_normalisation", "ol", f"WITH {MERCHANT_SQL} SELECT id, normalized FROM mk")
def merchants(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select("id", S.normalize_merchant("description_raw").alias("normalized"))


@query("expr11_merchant_key_and_name", "ol", f"WITH {MERCHANT_SQL} SELECT id, merchant_key, merchant_name FROM mk")
def merchant_keys(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select("id", S.merchant_key().alias("merchant_key"), S.merchant_name().alias("merchant_name"))


@query("expr12_vendor", "ol", "SELECT id, coalesce(nullif(merchant_normalized, ''), description_raw) AS vendor FROM ol")
def vendors(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select("id", S.vendor().alias("vendor"))


@query("expr14_cents", "", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) * 100, 0) AS BIGINT) AS cents FROM lineitem")
def cents(spark: SparkSession, d: str) -> DataFrame:
    off = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    return L.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.cents(off).alias("cents"))


@query("expr17_account_label", "ac", "SELECT account_id, institution || ' · ' || account_name AS label FROM ac")
def account_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.accounts(spark, d).select("account_id", S.account_label().alias("label"))


@query("expr18_tokens", "", r"""
WITH stop AS (SELECT ['all', 'and', 'annual', 'export', 'history', 'if', 'in', 'of', 'or', 'pdf', 'screenshot', 'the', 'ytd', '2026', '2027'] AS w)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(url), '[a-z]+|[0-9]+'), lambda t: length(t) > 2 AND NOT list_contains(w, t)))), ' ') AS tokens
FROM pages, stop
""")
def token_lists(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(S.tokens("url")), " ").alias("tokens"))


@query("mnt2_key_collisions", "ol", """
SELECT account_id, strftime(occurred_on, '%Y-%m') AS month, count(*) AS n FROM ol GROUP BY 1, 2 HAVING count(*) > 1
""")
def key_collisions(spark: SparkSession, d: str) -> DataFrame:
    rows = _base(spark, d).select("account_id", S.month_label("occurred_on").alias("month"))
    return maintenance.key_collisions(rows, ["account_id", "month"])

"""Check register, deposit ledger and account resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import registers
from tallyframe.plans.registry import query
from tallyframe.sources import sample_ledger as L


def check_entries(spark: SparkSession, d: str) -> DataFrame:
    """Register entries for every check of the ledger, some altered: number, amount, label, repeats, blanks."""
    n = F.substring("id", 2, L.ID_WIDTH).cast("bigint")
    names = L.accounts(spark, d).select("account_id", "account_name")
    checks = (
        L.orders_ledger(spark, d, household=False)
        .where(F.col("description_raw").startswith("CHECK#"))
        .join(names, "account_id")
        .withColumn("n", n)
        .withColumn("copy", F.explode(F.when(n % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    )
    number = F.when(F.col("n") % 3 == 1, F.concat(F.lit("9"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))
    amount = F.when(F.col("n") % 7 == 2, F.abs("amount") + 1).otherwise(F.abs("amount"))
    label = F.when(F.col("n") % 2 == 0, F.upper("account_name")).when(F.col("n") % 13 == 1, "nobody").otherwise(F.col("account_id"))
    return checks.select(
        (F.col("n") * 2 + F.col("copy")).alias("entry_id"),
        label.alias("account"),
        number.alias("check_number"),
        F.date_sub("occurred_on", (F.col("n") % 14).cast("int")).cast("string").alias("date_written"),
        F.concat(F.lit("$"), amount.cast("string")).alias("amount"),
        F.when(F.col("n") % 17 == 3, "").otherwise(F.concat(F.lit("Payee "), F.col("n").cast("string"))).alias("payee"),
        F.lit("medical").alias("primary_category"),
        F.lit("").alias("subcategory"),
        F.lit("").alias("lifecycle"),
        F.lit("").alias("household_role"),
        F.lit("note").alias("notes"),
    )


ENTRY_SQL = """
ce AS (
  SELECT n * 2 + cp AS entry_id, n, CASE WHEN n % 2 = 0 THEN upper(account_name) WHEN n % 13 = 1 THEN 'nobody' ELSE ol.account_id END AS account,
    CASE WHEN n % 3 = 1 THEN '9' || CAST(n AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS check_number,
    occurred_on - CAST(n % 14 AS INTEGER) AS written, CASE WHEN n % 7 = 2 THEN abs(amount) + 1 ELSE abs(amount) END AS amt,
    CASE WHEN n % 17 = 3 THEN '' ELSE 'Payee ' || CAST(n AS VARCHAR) END AS payee
  FROM ol JOIN ac ON ac.account_id = ol.account_id, (VALUES (0), (1)) v(cp)
  WHERE description_raw LIKE 'CHECK#%' AND (cp = 0 OR n % 11 = 0)),
dp AS (SELECT lower(account) AS la, check_number AS cn, count(*) AS copies FROM ce GROUP BY 1, 2),
rs AS (
  SELECT ce.*, copies, (SELECT account_id FROM ac WHERE ac.account_id = ce.account OR lower(account_name) = lower(ce.account)
    ORDER BY account_name, account_id LIMIT 1) AS acct
  FROM ce JOIN dp ON la = lower(account) AND cn = check_number),
pb AS (SELECT *, CASE WHEN payee = '' THEN 'missing_value' WHEN copies > 1 THEN 'duplicate' WHEN acct IS NULL THEN 'unknown_account' END AS problem FROM rs),
ck AS (SELECT id, account_id, abs(amount) AS amt, coalesce(posted_on, occurred_on) AS day, description_raw FROM ol WHERE description_raw ILIKE 'CHECK#%'),
sh AS (
  SELECT entry_id, count(*) AS c, min(id) AS one FROM pb JOIN ck ON ck.account_id = acct AND ck.amt = pb.amt
    AND regexp_full_match(description_raw, '(?i)\\s*CHECK#\\s*0*' || check_number || '\\s*') WHERE problem IS NULL GROUP BY 1),
wh AS (
  SELECT entry_id, count(*) AS c, min(id) AS one FROM pb JOIN ck ON ck.account_id = acct AND ck.amt = pb.amt
    AND abs(day - written) <= 10 WHERE problem IS NULL GROUP BY 1),
oc AS (
  SELECT pb.*, coalesce(sh.c, wh.c, 0) AS cnt, coalesce(sh.one, wh.one) AS one, CASE WHEN sh.c IS NOT NULL THEN 'strict' ELSE 'window' END AS tr
  FROM pb LEFT JOIN sh ON sh.entry_id = pb.entry_id LEFT JOIN wh ON wh.entry_id = pb.entry_id)"""


@query("join10_check_match", "ol ac", f"""
WITH {ENTRY_SQL}
SELECT entry_id, CAST(cnt AS BIGINT) AS candidate_count, CASE WHEN cnt = 1 THEN one END AS transaction_id, CASE WHEN cnt = 1 THEN tr END AS tier
FROM oc WHERE problem IS NULL
""")
def check_match(spark: SparkSession, d: str) -> DataFrame:
    out = registers.check_register(check_entries(spark, d), L.accounts(spark, d), L.orders_ledger(spark, d, household=False))
    kept = ~F.col("outcome").isin("missing_value", "duplicate", "unknown_account", "parse_error")
    return out.where(kept).select("entry_id", "candidate_count", "transaction_id", "tier")


@query("reg1_check_register", "ol ac ov", f"""
WITH {ENTRY_SQL},
mt AS (
  SELECT entry_id, CASE WHEN problem IS NOT NULL THEN problem WHEN cnt = 1 THEN 'matched' WHEN cnt > 1 THEN 'ambiguous_fallback'
    ELSE 'no_matching_transaction' END AS outcome, CASE WHEN problem IS NULL AND cnt = 1 THEN one END AS tx, payee, check_number FROM oc)
SELECT entry_id, outcome, CASE WHEN outcome = 'matched' THEN payee END AS merchant_normalized,
  CASE WHEN outcome = 'matched' THEN 'Check #' || check_number || ' to ' || payee || ' - note [register entry ' || CAST(entry_id AS VARCHAR) || ']' END AS note,
  CASE WHEN outcome = 'matched' THEN EXISTS (SELECT 1 FROM ov JOIN ol ON ol.id = tx AND ov.match_key = substr(sha256(ol.account_id || '|'
    || CAST(ol.occurred_on AS VARCHAR) || '|' || CAST(ol.amount AS VARCHAR) || '|' || lower(ol.description_raw)), 1, 24)) END AS superseded
FROM mt
""")
def check_register(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, household=False)
    out = registers.check_register(check_entries(spark, d), L.accounts(spark, d), ledger)
    requests = registers.register_overrides(out, ledger, L.overrides(spark, d), kind="check")
    written = requests.select(
        F.regexp_extract("note", r"entry (\d+)\]$", 1).cast("bigint").alias("entry_id"), "merchant_normalized", "note", "superseded"
    )
    return out.select("entry_id", "outcome").join(written, "entry_id", "left")


def deposit_entries(spark: SparkSession, d: str) -> DataFrame:
    """Deposit entries for every mobile deposit, shifted by up to five days, some of another amount."""
    n = F.substring("id", 2, L.ID_WIDTH).cast("bigint")
    rows = L.orders_ledger(spark, d, household=False).where("description_raw = 'MOBILE CHECK DEPOSIT'").withColumn("n", n)
    return rows.select(
        F.col("n").alias("entry_id"),
        F.col("account_id").alias("account"),
        F.date_add("occurred_on", (F.col("n") / 50 % 6).cast("int")).cast("string").alias("date_deposited"),
        F.when((F.col("n") / 50).cast("int") % 9 == 0, F.abs("amount") + 5).otherwise(F.abs("amount")).cast("string").alias("amount"),
        F.lit("Refund Office").alias("source"),
        F.when(F.col("n") % 4 == 3, "rental").otherwise("").alias("primary_category"),
        F.lit("").alias("subcategory"),
        F.lit("").alias("lifecycle"),
        F.lit("").alias("household_role"),
        F.lit("").alias("notes"),
    )


DEPOSIT_SQL = """
de AS (
  SELECT n AS entry_id, account_id, occurred_on + CAST(n // 50 % 6 AS INTEGER) AS day,
    CASE WHEN n // 50 % 9 = 0 THEN abs(amount) + 5 ELSE abs(amount) END AS amt, n
  FROM ol WHERE description_raw = 'MOBILE CHECK DEPOSIT'),
dd AS (SELECT account_id, day, amt, count(*) AS copies FROM de GROUP BY ALL),
dm AS (
  SELECT de.entry_id, any_value(de.n) AS n, any_value(copies) AS copies, count(o.id) AS c, min(o.id) AS one
  FROM de JOIN dd ON dd.account_id = de.account_id AND dd.day = de.day AND dd.amt = de.amt
    LEFT JOIN ol o ON o.account_id = de.account_id AND abs(o.amount) = de.amt AND abs(o.occurred_on - de.day) <= 3
      AND o.description_raw = 'MOBILE CHECK DEPOSIT' GROUP BY 1)"""


@query("join11_deposit_match", "ol", f"""
WITH {DEPOSIT_SQL}
SELECT entry_id, CAST(c AS BIGINT) AS candidate_count, CASE WHEN c = 1 THEN one END AS transaction_id FROM dm WHERE copies = 1
""")
def deposit_match(spark: SparkSession, d: str) -> DataFrame:
    out = registers.deposit_ledger(deposit_entries(spark, d), L.accounts(spark, d), L.orders_ledger(spark, d, household=False))
    return out.where("outcome <> 'duplicate'").select("entry_id", "candidate_count", "transaction_id")


@query("reg2_deposit_ledger", "ol", f"""
WITH {DEPOSIT_SQL}
SELECT entry_id, CASE WHEN copies > 1 THEN 'duplicate' WHEN c = 1 THEN 'matched' WHEN c > 1 THEN 'ambiguous_match' ELSE 'no_matching_transaction' END AS outcome,
  CASE WHEN copies = 1 AND c = 1 THEN CASE WHEN n % 4 = 3 THEN 'rental' ELSE 'income' END END AS primary_category
FROM dm
""")
def deposit_ledger(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, household=False)
    out = registers.deposit_ledger(deposit_entries(spark, d), L.accounts(spark, d), ledger)
    requests = registers.register_overrides(out, ledger, L.overrides(spark, d), kind="deposit")
    written = requests.select(F.regexp_extract("note", r"entry (\d+)\]$", 1).cast("bigint").alias("entry_id"), "primary_category")
    return out.select("entry_id", "outcome").join(written, "entry_id", "left")


@query("join12_account_label", "ac", """
WITH q AS (SELECT k, CASE k % 4 WHEN 0 THEN ' ' || account_id || ' ' WHEN 1 THEN lower(account_name) WHEN 2 THEN upper(account_name) ELSE 'missing' END AS account FROM ac)
SELECT k AS entry_id, (SELECT account_id FROM ac WHERE ac.account_id = trim(q.account) OR lower(account_name) = lower(trim(q.account))
  ORDER BY account_name, account_id LIMIT 1) AS account_id FROM q
""")
def account_label(spark: SparkSession, d: str) -> DataFrame:
    accounts = L.accounts(spark, d)
    k = F.substring("account_id", 6, L.ID_WIDTH).cast("bigint")
    label = F.when(k % 4 == 0, F.concat(F.lit(" "), "account_id", F.lit(" "))).when(k % 4 == 1, F.lower("account_name")).when(k % 4 == 2, F.upper("account_name")).otherwise("missing")
    return registers.resolve_label(accounts.select(k.alias("entry_id"), label.alias("account")), accounts).select("entry_id", "account_id")


@query("join13_account_alias", "ac", """
WITH q AS (SELECT k, CASE WHEN k % 3 = 0 THEN account_id ELSE upper(replace(institution, '-', ' ')) END AS account FROM ac),
al AS (SELECT regexp_replace(lower(institution), '[^a-z0-9]', '', 'g') AS s, count(*) AS n, min(account_id) AS one FROM ac GROUP BY 1)
SELECT q.k AS entry_id, coalesce(i.account_id, CASE WHEN n = 1 THEN one END) AS account_id,
  CASE WHEN coalesce(i.account_id, CASE WHEN n = 1 THEN one END) IS NULL THEN CASE WHEN n > 1 THEN 'ambiguous_alias' ELSE 'unknown_account' END END AS resolve_error
FROM q LEFT JOIN ac i ON i.account_id = q.account LEFT JOIN al ON s = regexp_replace(lower(q.account), '[^a-z0-9]', '', 'g')
""")
def account_alias(spark: SparkSession, d: str) -> DataFrame:
    accounts = L.accounts(spark, d)
    k = F.substring("account_id", 6, L.ID_WIDTH).cast("bigint")
    label = F.when(k % 3 == 0, F.col("account_id")).otherwise(F.upper(F.regexp_replace("institution", "-", " ")))
    return registers.resolve_alias(accounts.select(k.alias("entry_id"), label.alias("account")), accounts).select(
        "entry_id", "account_id", "resolve_error"
    )


@query("join14_config_lookup", "ac", """
WITH cfg AS (
  SELECT account_id AS key, CAST(k AS DOUBLE) AS opening FROM ac WHERE k % 5 = 0
  UNION ALL SELECT lower(institution), CAST(max(k) + 1000000 AS DOUBLE) FROM ac WHERE k % 2 = 0 GROUP BY 1)
SELECT ac.account_id, coalesce(a.opening, b.opening) AS opening FROM ac LEFT JOIN cfg a ON a.key = ac.account_id LEFT JOIN cfg b ON b.key = lower(institution)
""")
def config_lookup(spark: SparkSession, d: str) -> DataFrame:
    accounts = L.accounts(spark, d)
    k = F.substring("account_id", 6, L.ID_WIDTH).cast("bigint")
    by_id = accounts.where(k % 5 == 0).select(F.col("account_id").alias("key"), k.cast("double").alias("opening"))
    by_name = accounts.where(k % 2 == 0).groupBy(F.lower("institution").alias("key")).agg((F.max(k) + 1000000).cast("double").alias("opening"))
    return registers.lookup_config(accounts, by_id.unionByName(by_name), ["opening"]).select("account_id", "opening")

"""Rules, overrides and classification runs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators import dashboard, overrides, rules
from tallyframe.plans.catalog.summaries import doubles
from tallyframe.plans.registry import query
from tallyframe.schema import RULES
from tallyframe.sources import sample_ledger as L

STAMP = datetime.datetime(2026, 1, 1)

# Rules for the derived descriptions: part names stand in for merchants.
SAMPLE_RULES = (
    ("r-none", "ring", None, None, None, None, None, None, None, "low", 1, STAMP),
    ("r-ring", "RING\\b", None, "outflow", "variable_lifestyle", "jewelry", "Ring Shop", None, "one_time", "high", 10, STAMP),
    ("r-widget", "widget", None, None, "medical", None, None, None, None, "medium", 20, STAMP),
    ("r-blank", "^small", None, None, None, "", None, "pet", None, "medium", 20, STAMP),
    ("r-acct", ".+", "acct-000000000007", None, "tax", None, "Account Seven", None, None, "low", 30, STAMP),
    ("r-check", "(?i)check#", None, "inflow", "income", "check_deposit", None, None, None, "high", 5, STAMP),
    ("r-transfer", ".+", None, "transfer", "transfer", None, None, None, None, "high", 900, STAMP),
)

RULE_SQL = """
hit AS (
  SELECT *, CASE
    WHEN direction = 'inflow' AND regexp_matches(description_raw, '(?i)check#') THEN 'r-check'
    WHEN direction = 'outflow' AND regexp_matches(description_raw, '(?i)RING\\b') THEN 'r-ring'
    WHEN regexp_matches(description_raw, '(?i)^small') THEN 'r-blank'
    WHEN regexp_matches(description_raw, '(?i)widget') THEN 'r-widget'
    WHEN account_id = 'acct-000000000007' THEN 'r-acct'
    WHEN direction = 'transfer' THEN 'r-transfer' END AS rule_id FROM ol),
rl(rid, cat, sub, mer, rol, lif, conf) AS (VALUES
  ('r-check', 'income', 'check_deposit', NULL, NULL, NULL, 'high'), ('r-ring', 'variable_lifestyle', 'jewelry', 'Ring Shop', NULL, 'one_time', 'high'),
  ('r-blank', NULL, '', NULL, 'pet', NULL, 'medium'), ('r-widget', 'medical', NULL, NULL, NULL, NULL, 'medium'),
  ('r-acct', 'tax', NULL, 'Account Seven', NULL, NULL, 'low'), ('r-transfer', 'transfer', NULL, NULL, NULL, NULL, 'high'))"""


def sample_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE_RULES), RULES)


def _ledger(spark: SparkSession, d: str, **options: bool) -> DataFrame:
    return L.orders_ledger(spark, d, **options).withColumn("metadata", S.no_metadata())


def _loaded(spark: SparkSession) -> list:
    return rules.load_rules(sample_rules(spark))


@query("join7_rule_match", "ol", f"""
WITH {RULE_SQL}
SELECT id, rule_id, conf AS confidence FROM hit LEFT JOIN rl ON rid = rule_id
""")
def rule_match(spark: SparkSession, d: str) -> DataFrame:
    matched = rules.match_rules(L.orders_ledger(spark, d, household=False), _loaded(spark))
    return matched.select("id", "match.rule_id", "match.confidence")


def long_rules(spark: SparkSession, d: str) -> DataFrame:
    """One rule per part, as many as there are parts: names with and without a gap, filters, rules without outputs, catch-alls."""
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    name = F.when(key % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "(?: |\\\\s{2,})"))
    return L.table(spark, d, "part").select(
        F.concat(F.lit("m-"), F.lpad(key.cast("string"), 9, "0")).alias("id"),
        F.when(key % 50 == 9, F.lit(".+")).otherwise(name).alias("pattern"),
        F.when(key % 3 == 0, F.concat(F.lit("acct-"), F.lpad((key % 101).cast("string"), 12, "0"))).otherwise(F.when(key % 50 == 9, F.lit("acct-000000000003"))).alias("account_filter"),
        F.when(key % 4 == 1, F.lit("inflow")).when(key % 4 == 3, F.lit("outflow")).otherwise(F.lit("")).alias("direction_filter"),
        F.when(key % 11 != 0, F.concat(F.lit("c"), (key % 7).cast("string"))).alias("primary_category"), none.alias("subcategory"),
        none.alias("merchant_normalized"), none.alias("household_role"), none.alias("lifecycle"), F.lit("high").alias("confidence"),
        (key * 37 % 1009).cast("int").alias("priority"), F.lit("2026-01-01").cast("timestamp").alias("created_at"),
    )


LONG_RULE_SQL = """
mr AS (
  SELECT 'm-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS rid, CASE WHEN p_partkey % 50 = 9 THEN '' ELSE p_name END AS part,
    CASE WHEN p_partkey % 3 = 0 THEN 'acct-' || lpad(CAST(p_partkey % 101 AS VARCHAR), 12, '0') WHEN p_partkey % 50 = 9 THEN 'acct-000000000003' END AS acct,
    CASE p_partkey % 4 WHEN 1 THEN 'inflow' WHEN 3 THEN 'outflow' END AS dir, 'c' || p_partkey % 7 AS cat, p_partkey * 37 % 1009 AS pri
  FROM part WHERE p_partkey % 11 <> 0),
mh AS (
  SELECT id, arg_min(struct_pack(rid := rid, cat := cat), struct_pack(p := pri, i := rid)) AS m
  FROM ol JOIN mr ON (acct IS NULL OR acct = account_id) AND (dir IS NULL OR dir = direction) AND contains(lower(description_raw), part) GROUP BY id)"""


@query("join7_many_rules", "ol", f"""
WITH {LONG_RULE_SQL}
SELECT ol.id, m.rid AS rule_id, m.cat AS primary_category FROM ol LEFT JOIN mh ON mh.id = ol.id
""")
def many_rules(spark: SparkSession, d: str) -> DataFrame:
    matched = rules.match_rules(L.orders_ledger(spark, d, household=False), long_rules(spark, d))
    return matched.select("id", "match.rule_id", "match.primary_category")


@query("cls1_many_rules_counts", "ol ov", f"""
WITH {LONG_RULE_SQL},
g AS (SELECT DISTINCT account_id, occurred_on, amount, description_raw FROM ov)
SELECT household_id, count(*) AS scanned, count(*) FILTER (g.account_id IS NULL AND m IS NOT NULL) AS matched,
  count(*) FILTER (g.account_id IS NOT NULL OR m IS NULL) AS unclassified
FROM ol LEFT JOIN mh ON mh.id = ol.id LEFT JOIN g ON g.account_id = ol.account_id AND g.occurred_on = ol.occurred_on AND g.amount = ol.amount
  AND g.description_raw = ol.description_raw GROUP BY 1
""")
def many_rules_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify_counts(_ledger(spark, d), long_rules(spark, d), L.overrides(spark, d), reclassify_all=True, scope=["household_id"])


@query("cls1_classify", "ol ov", f"""
WITH {RULE_SQL},
m AS (
  SELECT hit.*, CASE WHEN hit.primary_category = 'unclassified' THEN rule_id END AS used FROM hit),
c AS (
  SELECT m.* EXCLUDE (primary_category, subcategory, merchant_normalized, household_role, lifecycle),
    coalesce(cat, primary_category) AS c1, coalesce(sub, subcategory) AS c2, coalesce(mer, merchant_normalized) AS c3,
    coalesce(rol, household_role) AS c4, coalesce(lif, lifecycle) AS c5, conf,
    substr(sha256(account_id || '|' || CAST(occurred_on AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|'
      || lower(trim(regexp_replace(description_raw, '\\s+', ' ', 'g')))), 1, 24) AS key
  FROM m LEFT JOIN rl ON rid = used)
SELECT c.id, coalesce(ov.primary_category, c1) AS primary_category, coalesce(ov.subcategory, c2) AS subcategory,
  coalesce(ov.merchant_normalized, c3) AS merchant_normalized, coalesce(ov.household_role, c4) AS household_role,
  coalesce(ov.lifecycle, c5) AS lifecycle, used AS classifier_rule_id, conf AS classifier_confidence,
  ov.match_key IS NOT NULL AS flagged, nullif(ov.note, '') AS note
FROM c LEFT JOIN ov ON ov.match_key = c.key
""")
def classify(spark: SparkSession, d: str) -> DataFrame:
    out = rules.classify(_ledger(spark, d, household=False), _loaded(spark), L.overrides(spark, d))
    return out.select(
        "id", "primary_category", "subcategory", "merchant_normalized", "household_role", "lifecycle",
        S.metadata_field("metadata", "classifier_rule_id").alias("classifier_rule_id"),
        S.metadata_field("metadata", "classifier_confidence").alias("classifier_confidence"),
        S.is_flagged().alias("flagged"), S.metadata_field("metadata", overrides.NOTE).alias("note"),
    )


@query("cls1_reclassify_all_counts", "ol ov", f"""
WITH {RULE_SQL},
g AS (SELECT DISTINCT account_id, occurred_on, amount, description_raw FROM ov)
SELECT household_id, count(*) AS scanned, count(*) FILTER (g.account_id IS NULL AND rule_id IS NOT NULL) AS matched,
  count(*) FILTER (g.account_id IS NOT NULL OR rule_id IS NULL) AS unclassified
FROM hit LEFT JOIN g ON g.account_id = hit.account_id AND g.occurred_on = hit.occurred_on AND g.amount = hit.amount
  AND g.description_raw = hit.description_raw GROUP BY 1
""")
def reclassify_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify_counts(
        _ledger(spark, d), _loaded(spark), L.overrides(spark, d), reclassify_all=True, scope=["household_id"]
    )


def part_rules(part: DataFrame, pattern, category, priority, stamp: str) -> DataFrame:
    """Rule rows built from parts, with ``seq`` as their change order."""
    none = F.lit(None).cast("string")
    key = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("p-"), F.lpad(key.cast("string"), 9, "0")).alias("id"), pattern.alias("pattern"), none.alias("account_filter"),
        none.alias("direction_filter"), category.alias("primary_category"), none.alias("subcategory"),
        none.alias("merchant_normalized"), none.alias("household_role"), none.alias("lifecycle"), F.lit("high").alias("confidence"),
        priority.cast("int").alias("priority"), F.lit(stamp).cast("timestamp").alias("created_at"), key.alias("seq"),
    )


@query("cls2_upsert_rules", "", """
SELECT 'p-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id,
  CASE WHEN p_partkey % 5 = 0 AND p_partkey % 35 <> 0 THEN 'new ' || p_name ELSE p_name END AS pattern,
  CASE WHEN p_partkey % 5 = 0 AND p_partkey % 35 <> 0 THEN CAST(least(greatest(p_size, 6), 9) AS INTEGER) ELSE 100 END AS priority
FROM part WHERE p_partkey % 2 = 0 OR (p_partkey % 5 = 0 AND p_partkey % 35 <> 0)
""")
def upsert_rules(spark: SparkSession, d: str) -> DataFrame:
    """Stored rules for every second part; changes for every fifth, of which every seventh sets nothing."""
    part, key = L.table(spark, d, "part"), F.col("p_partkey")
    stored = part_rules(part.where(key % 2 == 0), F.col("p_name"), F.lit("medical"), F.lit(100), "2026-01-01").drop("seq")
    renamed = F.concat(F.lit("new "), F.col("p_name"))
    changes = part_rules(part.where(key % 5 == 0), renamed, F.when(key % 7 != 0, "tax"), F.col("p_size"), "2026-02-01")
    return rules.upsert_rules(stored, changes, manual=True).select("id", "pattern", "priority")


@query("top3_rules_in_order", "", """
SELECT 'p-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_size AS priority, p_name AS pattern FROM part ORDER BY p_size, id
""")
def rules_in_order(spark: SparkSession, d: str) -> DataFrame:
    stored = part_rules(L.table(spark, d, "part"), F.col("p_name"), F.lit("tax"), F.col("p_size"), "2026-01-01")
    return rules.in_order(stored).select("id", "priority", "pattern")


@query("agg20_rule_bands", "", """
SELECT CASE WHEN p_size < 5 THEN 'below_5' WHEN p_size = 5 THEN '5' WHEN p_size <= 9 THEN '6-9' ELSE '10+' END AS band, count(*) AS rules
FROM part GROUP BY 1
""")
def rule_bands(spark: SparkSession, d: str) -> DataFrame:
    stored = part_rules(L.table(spark, d, "part"), F.col("p_name"), F.lit("tax"), F.col("p_size"), "2026-01-01")
    return dashboard.rule_band_metrics(stored)


@query("fil6_rule_preview", "ol", """
WITH h AS (
  SELECT c.name AS candidate, id, description_raw FROM ol JOIN (VALUES ('blue', 'blue'), ('ring-end', 'ring #\\d+$'), ('state', ' ct$')) c(name, p)
    ON regexp_matches(description_raw, '(?i)' || p)),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY id) AS position, count(*) OVER (PARTITION BY candidate) AS match_count FROM h)
SELECT candidate, CAST(match_count AS BIGINT) AS match_count, CAST(position AS BIGINT) AS position, id, description_raw FROM r WHERE position <= 5
""")
def rule_preview(spark: SparkSession, d: str) -> DataFrame:
    candidates = [("blue", "blue"), ("ring-end", r"ring #\d+$"), ("state", " ct$"), ("empty", " ")]
    out = rules.preview(L.orders_ledger(spark, d, household=False), candidates)
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("fil8_rule_suggestion", "ol", r"""
WITH b AS (
  SELECT household_id, amount, CASE WHEN trim(coalesce(merchant_normalized, '')) <> '' THEN
      (SELECT w FROM (SELECT unnest(string_split(trim(merchant_normalized), ' ')) AS w, unnest(range(len(string_split(trim(merchant_normalized), ' ')))) AS i)
        WHERE regexp_matches(w, '[a-zA-Z]') ORDER BY length(w) DESC, i LIMIT 1)
    ELSE array_to_string(list_slice(regexp_split_to_array(CASE WHEN stem = '' THEN trim(description_raw) ELSE stem END, '\s+'), 1, 3), ' ') END AS base
  FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(description_raw), '[#*].*$', ''), '\s+\d[\d/\-:.]*\s*$', '')) AS stem FROM ol
    WHERE primary_category = 'unclassified' AND direction <> 'transfer') x),
g AS (SELECT household_id, regexp_replace(base, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS pattern, count(*) AS row_count, sum(abs(amount)) AS total
  FROM b GROUP BY 1, 2)
SELECT household_id, pattern, row_count, CAST(total AS DOUBLE) AS total FROM g ORDER BY household_id, row_count DESC, g.total DESC, pattern
""")
def rule_suggestion(spark: SparkSession, d: str) -> DataFrame:
    return doubles(rules.suggest(L.orders_ledger(spark, d)), "total")


@query("join1_overrides_at_ingest", "ol ov", """
SELECT ol.id, coalesce(ov.merchant_normalized, ol.merchant_normalized) AS merchant_normalized,
  coalesce(ov.primary_category, ol.primary_category) AS primary_category, coalesce(ov.subcategory, ol.subcategory) AS subcategory,
  coalesce(ov.lifecycle, ol.lifecycle) AS lifecycle, ov.match_key IS NOT NULL AS flagged
FROM ol LEFT JOIN ov ON ov.match_key = substr(sha256(ol.account_id || '|' || CAST(ol.occurred_on AS VARCHAR) || '|' || CAST(ol.amount AS VARCHAR)
  || '|' || lower(trim(regexp_replace(ol.description_raw, '\\s+', ' ', 'g')))), 1, 24)
""")
def overrides_at_ingest(spark: SparkSession, d: str) -> DataFrame:
    out = overrides.apply_overrides(_ledger(spark, d, household=False), L.overrides(spark, d))
    return out.select("id", "merchant_normalized", "primary_category", "subcategory", "lifecycle", S.is_flagged().alias("flagged"))


REQUEST_SQL = """
rq AS (
  SELECT DISTINCT account_id, occurred_on, amount, description_raw, CASE WHEN n % 2 = 0 THEN 'Renamed' END AS mer,
    CASE WHEN n % 40 = 0 THEN 'again' ELSE '' END AS nt,
    substr(sha256(account_id || '|' || CAST(occurred_on AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|'
      || lower(trim(regexp_replace(description_raw, '\\s+', ' ', 'g')))), 1, 24) AS key
  FROM ol WHERE n % 8 = 0 OR n % 9 = 0)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("id", 2, L.ID_WIDTH).cast("bigint")
    rows = L.orders_ledger(spark, d, household=False).where((n % 8 == 0) | (n % 9 == 0))
    return overrides.override_requests(
        rows, merchant_normalized=F.when(n % 2 == 0, "Renamed"), note=F.when(n % 40 == 0, "again").otherwise("")
    )


@query("join2_upsert_overrides", "ol ov", f"""
WITH {REQUEST_SQL}
SELECT coalesce(ov.match_key, rq.key) AS match_key, coalesce(ov.account_id, rq.account_id) AS account_id,
  coalesce(rq.mer, ov.merchant_normalized) AS merchant_normalized, ov.primary_category, ov.lifecycle,
  CASE WHEN coalesce(rq.nt, '') <> '' THEN rq.nt ELSE coalesce(ov.note, '') END AS note
FROM ov FULL OUTER JOIN rq ON rq.key = ov.match_key
""")
def upsert_overrides(spark: SparkSession, d: str) -> DataFrame:
    out = overrides.upsert_overrides(L.overrides(spark, d), _requests(spark, d))
    return out.select("match_key", "account_id", "merchant_normalized", "primary_category", "lifecycle", "note")


@query("join3_reapply_overrides", "ol ov", f"""
WITH {REQUEST_SQL},
mg AS (
  SELECT coalesce(ov.match_key, rq.key) AS match_key, coalesce(rq.mer, ov.merchant_normalized) AS mer, ov.primary_category AS cat
  FROM ov FULL OUTER JOIN rq ON rq.key = ov.match_key)
SELECT ol.id, coalesce(mer, merchant_normalized) AS merchant_normalized, coalesce(cat, primary_category) AS primary_category
FROM ol LEFT JOIN mg ON mg.match_key = substr(sha256(ol.account_id || '|' || CAST(ol.occurred_on AS VARCHAR) || '|' || CAST(ol.amount AS VARCHAR)
  || '|' || lower(trim(regexp_replace(ol.description_raw, '\\s+', ' ', 'g')))), 1, 24)
""")
def reapply_overrides(spark: SparkSession, d: str) -> DataFrame:
    merged = overrides.upsert_overrides(L.overrides(spark, d), _requests(spark, d))
    out = overrides.apply_overrides(_ledger(spark, d, household=False), merged)
    return out.select("id", "merchant_normalized", "primary_category")


TUPLE_JOIN = "o.account_id = ol.account_id AND o.occurred_on = ol.occurred_on AND o.amount = ol.amount AND o.description_raw = ol.description_raw"


@query("join4_override_governed_rows", "ol ov", f"SELECT id FROM ol WHERE EXISTS (SELECT 1 FROM ov o WHERE {TUPLE_JOIN})")
def governed(spark: SparkSession, d: str) -> DataFrame:
    return overrides.governed_rows(L.orders_ledger(spark, d, household=False), L.overrides(spark, d)).select("id")


@query("join5_orphaned_overrides", "ol ov", f"SELECT match_key FROM ov o WHERE NOT EXISTS (SELECT 1 FROM ol WHERE {TUPLE_JOIN})")
def orphaned(spark: SparkSession, d: str) -> DataFrame:
    return overrides.orphaned_overrides(L.orders_ledger(spark, d, household=False), L.overrides(spark, d)).select("match_key")


@query("join6_override_in_effect", "ol ov", f"""
SELECT id, o.match_key, array_to_string(list_filter([
    CASE WHEN o.merchant_normalized IS NOT NULL AND o.merchant_normalized IS DISTINCT FROM ol.merchant_normalized THEN 'merchant_normalized' END,
    CASE WHEN o.primary_category IS NOT NULL AND o.primary_category IS DISTINCT FROM ol.primary_category THEN 'primary_category' END,
    CASE WHEN o.subcategory IS NOT NULL AND o.subcategory IS DISTINCT FROM ol.subcategory THEN 'subcategory' END,
    CASE WHEN o.lifecycle IS NOT NULL AND o.lifecycle IS DISTINCT FROM ol.lifecycle THEN 'lifecycle' END], lambda x: x IS NOT NULL), ',') AS differs
FROM ol JOIN ov o ON {TUPLE_JOIN}
""")
def override_effect(spark: SparkSession, d: str) -> DataFrame:
    out = overrides.override_effect(_ledger(spark, d, household=False), L.overrides(spark, d))
    return out.select("id", "match_key", "differs")


@query("join21_bulk_override", "ol", """
WITH src AS (
  SELECT household_id, merchant_normalized AS m, description_raw AS dr FROM ol WHERE n % 500 IN (0, 1)),
k AS (
  SELECT DISTINCT household_id, CASE WHEN coalesce(m, '') <> '' THEN m END AS m, CASE WHEN coalesce(m, '') = '' THEN dr END AS dr FROM src)
SELECT DISTINCT ol.account_id, ol.occurred_on, CAST(ol.amount AS DOUBLE) AS amount, ol.description_raw, 'medical' AS primary_category,
  CAST(NULL AS VARCHAR) AS subcategory, 'joint' AS household_role
FROM ol JOIN k ON k.household_id = ol.household_id AND (ol.merchant_normalized = k.m OR ol.description_raw = k.dr)
""")
def bulk_override(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d)
    n = F.substring("id", 2, L.ID_WIDTH).cast("bigint")
    sources = (
        ledger.where((n % 500).isin(0, 1))
        .select("household_id", "merchant_normalized", F.when(F.coalesce("merchant_normalized", F.lit("")) == "", F.col("description_raw")).alias("description_raw"))
        .distinct()
        .select(
            "*", F.lit("medical").alias("category"), F.lit("").alias("sub"), F.lit("joint").alias("role"), F.lit("").alias("cycle")
        )
    )
    out = overrides.bulk_override(ledger, sources)
    names = ["account_id", "occurred_on", "amount", "description_raw", "primary_category", "subcategory", "household_role"]
    return doubles(out.select(*names).distinct(), "amount")


@query("mnt3_rename_label", "ol ov", """
SELECT ol.id, CASE WHEN ol.subcategory = 'streaming' THEN 'streaming_video' ELSE coalesce(ov.subcategory, ol.subcategory) END AS subcategory,
  (ol.subcategory = 'streaming' AND ol.subcategory IS NOT NULL) OR ov.match_key IS NOT NULL AS flagged
FROM ol LEFT JOIN ov ON ov.match_key = substr(sha256(ol.account_id || '|' || CAST(ol.occurred_on AS VARCHAR)
  || '|' || CAST(ol.amount AS VARCHAR) || '|' || lower(trim(regexp_replace(ol.description_raw, '\\s+', ' ', 'g')))), 1, 24)
""")
def rename_label(spark: SparkSession, d: str) -> DataFrame:
    """A rename on top of the overrides that are stored already."""
    ledger = _ledger(spark, d, household=False)
    requests = overrides.rename_label(ledger, "subcategory", "streaming", "streaming_video")
    merged = overrides.upsert_overrides(L.overrides(spark, d), requests)
    return overrides.apply_overrides(ledger, merged).select("id", "subcategory", S.is_flagged().alias("flagged"))


@query("agg20_override_metrics", "ol ov", f"""
SELECT 'overrides' AS metric, count(*) AS n FROM ov
UNION ALL SELECT 'rows_matching', count(*) FROM ol WHERE EXISTS (SELECT 1 FROM ov o WHERE {TUPLE_JOIN})
UNION ALL SELECT 'rows_stamped', count(*) FROM ol JOIN ov ON ov.match_key = substr(sha256(ol.account_id || '|' || CAST(ol.occurred_on AS VARCHAR)
  || '|' || CAST(ol.amount AS VARCHAR) || '|' || lower(trim(regexp_replace(ol.description_raw, '\\s+', ' ', 'g')))), 1, 24)
""")
def override_metrics(spark: SparkSession, d: str) -> DataFrame:
    ledger = overrides.apply_overrides(_ledger(spark, d, household=False), L.overrides(spark, d))
    return dashboard.override_metrics(ledger, L.overrides(spark, d))

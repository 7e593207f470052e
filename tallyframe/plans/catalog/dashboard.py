"""Dashboard figures, filters, paging and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators import dashboard, filters, summaries
from tallyframe.plans.catalog.summaries import doubles
from tallyframe.plans.registry import query
from tallyframe.sources import sample_ledger as L

CF_SQL = """
cf AS (
  SELECT household_id, strftime(occurred_on, '%Y-%m') AS month,
    coalesce(sum(amount) FILTER (primary_category = 'income' AND direction = 'inflow'), 0) AS inflow,
    coalesce(sum(abs(amount)) FILTER (primary_category IN ('fixed_obligation', 'variable_lifestyle', 'medical', 'abnormal')
      AND direction <> 'inflow'), 0) AS outflow
  FROM ol GROUP BY 1, 2)"""


def mean_sql(total: str, count: str) -> str:
    """``total / count`` to the cent, half away from zero, in whole cents."""
    return f"CAST(sign({total}) * ((CAST(abs({total}) * 100 AS HUGEINT) * 2 + {count}) // (2 * {count})) AS DOUBLE) / 100"


def _months(spark: SparkSession, d: str) -> DataFrame:
    return summaries.monthly_flow(L.orders_ledger(spark, d, describe=False))


@query("agg18_dashboard_kpis", "ol", f"""
WITH {CF_SQL}
SELECT household_id, count(*) AS month_count, CAST(sum(inflow) AS DOUBLE) AS total_inflow, CAST(sum(outflow) AS DOUBLE) AS total_outflow,
  CAST(sum(inflow) - sum(outflow) AS DOUBLE) AS net, {mean_sql("sum(inflow)", "count(*)")} AS avg_inflow,
  {mean_sql("sum(outflow)", "count(*)")} AS avg_outflow
FROM cf GROUP BY 1
""")
def kpis(spark: SparkSession, d: str) -> DataFrame:
    return doubles(dashboard.kpis(_months(spark, d)), "total_inflow", "total_outflow", "net")


@query("fil3_range_last_12_months", "ol", f"""
WITH {CF_SQL}
SELECT household_id, month, CAST(inflow AS DOUBLE) AS inflow, CAST(outflow AS DOUBLE) AS outflow, month >= '2000-09' AS in_12mo,
  month >= '2001-01' AS in_ytd, month BETWEEN '1998-03' AND '1999-10' AS in_custom FROM cf
""")
def ranges(spark: SparkSession, d: str) -> DataFrame:
    months = doubles(_months(spark, d).drop("net_cash_flow"), "inflow", "outflow")
    return months.withColumns(
        {
            "in_12mo": filters.month_range("12mo", L.AS_OF),
            "in_ytd": filters.month_range("ytd", L.AS_OF),
            "in_custom": filters.month_range("custom", L.AS_OF, start="1998-03", end="1999-10"),
        }
    )


@query("win5_trailing_change", "ol", f"""
WITH {CF_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY month DESC) AS rn, count(*) OVER (PARTITION BY household_id) AS n FROM cf),
s AS (
  SELECT household_id, max(n) AS n,
    CASE WHEN max(n) >= 6 THEN sum(inflow) FILTER (rn <= 3) ELSE sum(inflow) FILTER (rn = 1) END AS i_now,
    CASE WHEN max(n) >= 6 THEN sum(inflow) FILTER (rn BETWEEN 4 AND 6) ELSE sum(inflow) FILTER (rn = 2) END AS i_old,
    CASE WHEN max(n) >= 6 THEN sum(outflow) FILTER (rn <= 3) ELSE sum(outflow) FILTER (rn = 1) END AS o_now,
    CASE WHEN max(n) >= 6 THEN sum(outflow) FILTER (rn BETWEEN 4 AND 6) ELSE sum(outflow) FILTER (rn = 2) END AS o_old
  FROM r GROUP BY 1)
SELECT household_id,
  CASE WHEN n >= 2 AND i_old <> 0 THEN round((CAST(i_now AS DOUBLE) - CAST(i_old AS DOUBLE)) / CAST(i_old AS DOUBLE), 6) END AS inflow_change,
  CASE WHEN n >= 2 AND o_old <> 0 THEN round((CAST(o_now AS DOUBLE) - CAST(o_old AS DOUBLE)) / CAST(o_old AS DOUBLE), 6) END AS outflow_change,
  CASE WHEN n >= 6 THEN 'trailing 3 months' WHEN n >= 2 THEN 'prior month' END AS basis
FROM s
""")
def trailing_change(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.trailing_change(_months(spark, d))


@query("agg15_subscription_audit", "ol", """
WITH g AS (
  SELECT household_id, coalesce(nullif(merchant_normalized, ''), description_raw) AS merchant, subcategory,
    nullif(household_role, '') AS household_role, count(*) AS charge_count,
    count(DISTINCT strftime(occurred_on, '%Y-%m')) AS month_count, sum(abs(amount)) AS total, max(occurred_on) AS last_charged_on
  FROM ol WHERE direction = 'outflow' AND primary_category = 'fixed_obligation'
    AND subcategory IN ('subscriptions_apps', 'streaming') GROUP BY ALL),
r AS (
  SELECT *, """ + mean_sql("total", "charge_count") + " AS avg_amount, " + mean_sql("total", "month_count") + """ AS monthly_burn FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY household_id
    ORDER BY monthly_burn DESC, merchant, subcategory, household_role NULLS FIRST) AS position FROM r)
SELECT household_id, merchant, subcategory, household_role, charge_count, month_count, CAST(total AS DOUBLE) AS total_amount,
  last_charged_on, avg_amount, monthly_burn, CAST(position AS BIGINT) AS position FROM p WHERE position <= 24
""")
def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    out = dashboard.subscription_audit(L.orders_ledger(spark, d))
    return doubles(out, "total_amount").withColumn("position", F.col("position").cast("bigint"))


def leakage_caps(spark: SparkSession, d: str) -> DataFrame:
    """Three capped categories per household."""
    caps = F.array(
        *[
            F.struct(F.lit(k).alias("category_key"), F.lit(n).alias("name"), F.lit(c).cast("decimal(18,2)").alias("monthly_cap"))
            for k, n, c in (("medical", "Medical", 200000), ("abnormal", "Abnormal", 250000), ("dining", "Dining", 100))
        ]
    )
    nation = L.table(spark, d, "nation")
    return nation.select(
        F.concat(F.lit("hh-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("household_id"), F.explode(caps).alias("c")
    ).select("household_id", "c.*")


LEAK_SQL = f"""
caps AS (
  SELECT 'hh-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS household_id, k AS category_key, nm AS name, CAST(c AS DOUBLE) AS monthly_cap
  FROM nation, (VALUES ('medical', 'Medical', 200000), ('abnormal', 'Abnormal', 250000), ('dining', 'Dining', 100)) v(k, nm, c)),
lk_m AS (
  SELECT household_id, primary_category, strftime(occurred_on, '%Y-%m') AS m, sum(abs(amount)) AS total
  FROM ol WHERE direction = 'outflow' GROUP BY 1, 2, 3),
leak AS (
  SELECT caps.*, coalesce((SELECT {mean_sql("sum(total)", "count(*)")} FROM lk_m
    WHERE lk_m.household_id = caps.household_id AND primary_category = category_key), 0.0) AS monthly_burn
  FROM caps)"""


@query("agg16_leakage_burn", "ol", f"""
WITH {LEAK_SQL}
SELECT household_id, category_key, name, monthly_cap, CAST(monthly_burn AS DOUBLE) AS monthly_burn, round(monthly_burn - monthly_cap, 2) AS over_by,
  CASE WHEN monthly_cap = 0 THEN 0.0 ELSE round(monthly_burn / monthly_cap, 6) END AS ratio, monthly_burn / monthly_cap > 1 AS is_over
FROM leak
""")
def leakage_burn(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.leakage_burn(L.orders_ledger(spark, d, describe=False), leakage_caps(spark, d))


@query("join19_leakage_category_average", "ol", f"""
WITH {LEAK_SQL}
SELECT household_id, category_key, CAST(monthly_burn AS DOUBLE) AS monthly_burn FROM leak
""")
def leakage_average(spark: SparkSession, d: str) -> DataFrame:
    return leakage_burn(spark, d).select("household_id", "category_key", "monthly_burn")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Month-end balance of every savings account: opening plus everything posted so far."""
    savings = L.accounts(spark, d).where("account_type = 'savings'").select("account_id")
    daily = (
        L.orders_ledger(spark, d, describe=False, household=False)
        .join(savings, "account_id")
        .groupBy("account_id", F.last_day("occurred_on").alias("day"))
        .agg(F.sum(S.posted_effect()).alias("moved"))
    )
    running = Window.partitionBy("account_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("account_id", "day", F.sum("moved").over(running).alias("balance"))


POINTS_SQL = """
pm AS (
  SELECT o.account_id, last_day(occurred_on) AS day, sum(effect) AS moved
  FROM ol o JOIN ac ON ac.account_id = o.account_id WHERE account_type = 'savings' GROUP BY 1, 2),
pt AS (SELECT account_id, day, sum(moved) OVER (PARTITION BY account_id ORDER BY day) AS balance FROM pm),
f AS (SELECT account_id, min(day) AS first_day, max(day) AS last_day, max_by(balance, day) AS last_balance, count(*) AS days FROM pt GROUP BY 1),
fit AS (
  SELECT pt.account_id, any_value(first_day) AS first_day, any_value(f.last_day) AS last_on, any_value(last_balance) AS last_balance,
    regr_slope(CAST(balance AS DOUBLE), CAST(day - first_day AS DOUBLE)) AS slope,
    regr_intercept(CAST(balance AS DOUBLE), CAST(day - first_day AS DOUBLE)) AS intercept
  FROM pt JOIN f ON f.account_id = pt.account_id WHERE days >= 2 GROUP BY 1),
line AS (
  SELECT account_id, round(slope, 4) AS daily_rate, CAST(500000 AS DOUBLE) AS target,
    CAST(CASE WHEN slope <= 0 THEN NULL WHEN last_balance >= 500000 THEN last_on
      ELSE first_day + CAST(floor((500000 - intercept) / slope) AS INTEGER) END AS DATE) AS gate_date
  FROM fit)"""


def _goal_line(spark: SparkSession, d: str) -> DataFrame:
    targets = L.accounts(spark, d).select("account_id", F.lit(500000.0).alias("target"))
    return dashboard.goal_line(_points(spark, d), targets)


@query("win9_goal_line", "ol ac", f"WITH {POINTS_SQL} SELECT * FROM line")
def goal_line(spark: SparkSession, d: str) -> DataFrame:
    return _goal_line(spark, d)


@query("sum5_feasibility", "ol ac ga", f"""
WITH {CF_SQL}, {LEAK_SQL}, {POINTS_SQL},
net AS (SELECT household_id, {mean_sql("(sum(inflow) - sum(outflow))", "count(*)")} AS avg_net FROM cf GROUP BY 1),
ov AS (SELECT household_id, round(sum(greatest(round(monthly_burn - monthly_cap, 2), 0.0)), 2) AS total_overage FROM leak GROUP BY 1),
gl AS (SELECT ga.household_id, gate_date FROM ga JOIN line ON line.account_id = ga.account_id),
j AS (
  SELECT ov.household_id, avg_net, gate_date, total_overage, gl.household_id IS NOT NULL AS has_line,
    CAST(gate_date - DATE '2001-08-01' AS DOUBLE) / 30.44 AS out_months
  FROM ov LEFT JOIN net ON net.household_id = ov.household_id LEFT JOIN gl ON gl.household_id = ov.household_id),
s AS (
  SELECT *, CASE WHEN avg_net IS NULL THEN 'unknown' WHEN avg_net < 0 THEN 'red' WHEN avg_net < 1500 THEN 'yellow' ELSE 'green' END AS net_flow_status,
    CASE WHEN NOT has_line THEN 'unknown' WHEN gate_date IS NULL THEN 'red' WHEN out_months <= 24 THEN 'green'
      WHEN out_months <= 48 THEN 'yellow' ELSE 'red' END AS goal_status,
    CASE WHEN total_overage > 1000 THEN 'red' WHEN total_overage > 300 THEN 'yellow' ELSE 'green' END AS leakage_status FROM j)
SELECT household_id, avg_net, gate_date, CAST(total_overage AS DOUBLE) AS total_overage, net_flow_status, goal_status, leakage_status,
  CASE WHEN 'red' IN (net_flow_status, goal_status, leakage_status) THEN 'red'
    WHEN 'yellow' IN (net_flow_status, goal_status, leakage_status) THEN 'yellow'
    WHEN 'green' IN (net_flow_status, goal_status, leakage_status) THEN 'green' ELSE 'unknown' END AS status
FROM s
""")
def feasibility(spark: SparkSession, d: str) -> DataFrame:
    goal = _goal_line(spark, d).join(L.goal_accounts(spark, d), "account_id").select("household_id", "gate_date")
    return dashboard.feasibility(_months(spark, d), goal, leakage_burn(spark, d), L.AS_OF)


FREQ_SQL = """
fq AS (
  SELECT household_id, coalesce(nullif(merchant_normalized, ''), description_raw) AS vendor, count(*) AS occurrences,
    count(*) FILTER (occurred_on >= DATE '2001-08-01' - 183) AS recent_occurrences
  FROM ol GROUP BY 1, 2)"""


@query("join18_merchant_frequency", "ol", f"""
WITH {FREQ_SQL}
SELECT id, vendor, occurrences, recent_occurrences
FROM ol JOIN fq ON fq.household_id = ol.household_id AND vendor = coalesce(nullif(merchant_normalized, ''), description_raw)
""")
def merchant_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = dashboard.with_merchant_frequency(L.orders_ledger(spark, d), L.AS_OF)
    return rows.select("id", "vendor", "occurrences", "recent_occurrences")


@query("set1_lifecycle_audit", "ol", f"""
WITH {FREQ_SQL},
c AS (
  SELECT ol.household_id, id, occurred_on, vendor, amount, primary_category, subcategory, lifecycle,
    CASE WHEN subcategory = 'pet_care' AND abs(amount) > 500 THEN 'pet_care_high_value'
      WHEN primary_category = 'variable_lifestyle' AND lifecycle = 'one_time' AND abs(amount) > 500 THEN 'discretionary_outlier_one_time'
      WHEN lifecycle = 'one_time' AND recent_occurrences >= 3 AND abs(amount) >= 100 THEN 'one_time_but_recurring_merchant'
      WHEN lifecycle = 'recurring' AND occurrences = 1 AND abs(amount) >= 100 THEN 'recurring_but_single_occurrence' END AS reason
  FROM ol JOIN fq ON fq.household_id = ol.household_id AND vendor = coalesce(nullif(merchant_normalized, ''), description_raw)),
r AS (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY abs(amount) DESC, id) AS position,
    count(*) OVER (PARTITION BY household_id) AS total FROM c WHERE reason IS NOT NULL)
SELECT household_id, id, occurred_on, vendor, CAST(amount AS DOUBLE) AS amount, primary_category, subcategory, lifecycle, reason,
  CAST(position AS BIGINT) AS position, CAST(total AS BIGINT) AS total FROM r WHERE position <= 100
""")
def lifecycle_audit(spark: SparkSession, d: str) -> DataFrame:
    out = dashboard.lifecycle_audit(L.orders_ledger(spark, d), L.AS_OF, min_amount=100)
    return doubles(out, "amount").withColumn("position", F.col("position").cast("bigint"))


@query("agg19_account_metrics", "ol ac", """
SELECT ac.account_id, institution, account_type, count(id) AS row_count, min(occurred_on) AS first_on, max(occurred_on) AS last_on
FROM ac LEFT JOIN ol ON ol.account_id = ac.account_id GROUP BY ALL
""")
def account_metrics(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.account_metrics(L.orders_ledger(spark, d, describe=False, household=False), L.accounts(spark, d))


@query("agg19_category_metrics", "ol", """
SELECT household_id, primary_category, count(*) AS all_time, count(*) FILTER (year(occurred_on) = 2001) AS in_year FROM ol GROUP BY 1, 2
""")
def category_metrics(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.category_metrics(L.orders_ledger(spark, d, describe=False), 2001)


@query("src25_rows_per_source", "ol", """
SELECT household_id, source_document_name, count(*) AS row_count FROM ol GROUP BY 1, 2
""")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.source_counts(L.orders_ledger(spark, d, describe=False))


@query("fil1_register_filter", "ol ac", """
SELECT id, account_id, CAST(amount AS DOUBLE) AS amount, description_raw FROM ol
WHERE direction = 'outflow' AND primary_category = 'medical'
  AND (merchant_normalized ILIKE '%ring%' OR description_raw ILIKE '%ring%')
""")
def register_filter(spark: SparkSession, d: str) -> DataFrame:
    condition = filters.register_filter(direction="outflow", category="medical", search=" ring ")
    rows = filters.register_rows(L.orders_ledger(spark, d, household=False), L.accounts(spark, d), condition)
    return doubles(rows.select("id", "account_id", "amount", "description_raw"), "amount")


@query("top1_register_page", "ol ac", """
SELECT id, occurred_on, institution || ' · ' || account_name AS account_label, CAST(amount AS DOUBLE) AS amount
FROM ol JOIN ac ON ac.account_id = ol.account_id WHERE direction <> 'transfer' ORDER BY occurred_on DESC, id DESC LIMIT 50 OFFSET 100
""")
def register_page(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False, household=False)
    page = filters.register_page(ledger, L.accounts(spark, d), filters.register_filter(), page=2)
    return doubles(page.select("id", "occurred_on", "account_label", "amount"), "amount")


@query("top1_register_total", "ol ac", """
SELECT count(*) AS total FROM ol JOIN ac ON ac.account_id = ol.account_id WHERE direction <> 'transfer'
""")
def register_total(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False, household=False)
    return filters.register_total(ledger, L.accounts(spark, d), filters.register_filter())


@query("top2_account_options", "ac", """
SELECT account_id, account_name, institution || ' · ' || account_name AS label FROM ac
""")
def account_options(spark: SparkSession, d: str) -> DataFrame:
    return filters.account_options(L.accounts(spark, d))


@query("fil2_leakage_drill_down", "ol", """
SELECT id, coalesce(nullif(merchant_normalized, ''), description_raw) AS vendor, CAST(abs(amount) AS DOUBLE) AS amount, occurred_on, description_raw
FROM ol WHERE direction = 'outflow' AND primary_category = 'abnormal' AND occurred_on BETWEEN DATE '1998-02-01' AND DATE '1999-02-28'
ORDER BY occurred_on DESC, id DESC LIMIT 200
""")
def leakage_rows(spark: SparkSession, d: str) -> DataFrame:
    out = filters.leakage_rows(L.orders_ledger(spark, d, household=False), "abnormal", "1998-02", "1999-02")
    return doubles(out, "amount")


@query("fil4_unclassified_backlog", "ol", """
SELECT household_id, count(*) AS total FROM ol WHERE primary_category = 'unclassified' AND direction <> 'transfer' GROUP BY 1
""")
def unclassified(spark: SparkSession, d: str) -> DataFrame:
    return filters.unclassified_count(L.orders_ledger(spark, d, describe=False))


@query("fil5_category_scopes", "ol", """
SELECT id, primary_category IN ('variable_lifestyle', 'medical', 'abnormal') AND direction <> 'inflow' AS discretionary,
  primary_category = 'income' AND direction = 'inflow' AS income,
  primary_category IN ('variable_lifestyle', 'medical', 'abnormal', 'fixed_obligation') AND direction = 'inflow' AS spend_offset,
  primary_category = 'income' AND direction = 'inflow' AND coalesce(subcategory, '') IN ('payroll', 'paycheck', 'bonus') AS pay_deposit
FROM ol
""")
def category_scopes(spark: SparkSession, d: str) -> DataFrame:
    from tallyframe.functions import predicates as P

    return L.orders_ledger(spark, d, describe=False, household=False).select(
        "id",
        P.is_discretionary().alias("discretionary"),
        P.is_income().alias("income"),
        P.is_spend_offset().alias("spend_offset"),
        F.coalesce(P.is_pay_deposit(), F.lit(False)).alias("pay_deposit"),
    )


@query("fil7_ad_hoc_sql", "", """
SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE o_totalprice > 1000 GROUP BY 1
""")
def ad_hoc(spark: SparkSession, d: str) -> DataFrame:
    L.table(spark, d, "orders").createOrReplaceTempView("ad_hoc_orders")
    return filters.read_only_sql(
        spark,
        "SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total "
        "FROM ad_hoc_orders WHERE o_totalprice > ? GROUP BY 1",
        [1000],
    )


@query("top4_capped_details", "ol", """
WITH r AS (
  SELECT primary_category, id, row_number() OVER (PARTITION BY primary_category ORDER BY id) AS position,
    count(*) OVER (PARTITION BY primary_category) AS details_total
  FROM ol WHERE merchant_normalized IS NULL)
SELECT primary_category, id, CAST(position AS BIGINT) AS position, CAST(details_total AS BIGINT) AS details_total FROM r WHERE position <= 50
""")
def capped_details(spark: SparkSession, d: str) -> DataFrame:
    rows = L.orders_ledger(spark, d, household=False).where("merchant_normalized IS NULL").select("primary_category", "id")
    out = filters.cap_details(rows, ["primary_category"], [F.col("id")])
    return out.withColumn("position", F.col("position").cast("bigint"))

"""Monthly, annual and goal summaries over the derived ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators import balances, loans, summaries
from tallyframe.plans.registry import query
from tallyframe.sources import sample_ledger as L


def doubles(df: DataFrame, *names: str) -> DataFrame:
    """Money columns as doubles at the very end, so both engines compare like values."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("agg1_monthly_flow", "ol", """
SELECT household_id, strftime(occurred_on, '%Y-%m') AS month,
  CAST(coalesce(sum(amount) FILTER (primary_category = 'income' AND direction = 'inflow'), 0) AS DOUBLE) AS inflow,
  CAST(coalesce(sum(abs(amount)) FILTER (primary_category IN ('fixed_obligation', 'variable_lifestyle', 'medical', 'abnormal')
    AND direction <> 'inflow'), 0) AS DOUBLE) AS outflow,
  CAST(coalesce(sum(amount) FILTER (primary_category = 'income' AND direction = 'inflow'), 0)
    - coalesce(sum(abs(amount)) FILTER (primary_category IN ('fixed_obligation', 'variable_lifestyle', 'medical', 'abnormal')
    AND direction <> 'inflow'), 0) AS DOUBLE) AS net_cash_flow
FROM ol GROUP BY 1, 2
""")
def monthly_flow(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.monthly_flow(L.orders_ledger(spark, d, describe=False))
    return doubles(out, "inflow", "outflow", "net_cash_flow")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    return summaries.month_measures(L.orders_ledger(spark, d, describe=False))


def _measure_query(name: str, column: str) -> None:
    @query(name, "ol mm", f"""
SELECT household_id, strftime(month_start, '%Y-%m') AS month, CAST({column} AS DOUBLE) AS {column} FROM mm
""")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return doubles(_measures(spark, d).select("household_id", S.month_label("month_start").alias("month"), column), column)


_measure_query("agg2_income_inflows", "inflows")
_measure_query("agg3_fixed_obligations", "fixed_obligations")
_measure_query("agg4_discretionary_spend", "discretionary")
_measure_query("agg5_income_offsets", "income_offsets")
_measure_query("agg6_spend_offsets", "spend_offsets")


@query("agg7_earned_income_reimbursements", "ol mm", """
SELECT household_id, month_start, CAST(inflows - income_offsets AS DOUBLE) AS earned_income,
  CAST(income_offsets + spend_offsets AS DOUBLE) AS reimbursements,
  CAST(income_offsets AS DOUBLE) AS reimbursements_income_side, CAST(spend_offsets AS DOUBLE) AS reimbursements_spend_side
FROM mm
""")
def earned_income(spark: SparkSession, d: str) -> DataFrame:
    names = ["earned_income", "reimbursements", "reimbursements_income_side", "reimbursements_spend_side"]
    return doubles(summaries.consumption_split(_measures(spark, d)).select("household_id", "month_start", *names), *names)


DEBT_SQL = """
tier AS (
  SELECT o.*, l.loan, l.annual_rate,
    coalesce((SELECT max_by(scheduled_payment, effective_from) FROM lt WHERE lt.loan = l.loan AND effective_from <= o.occurred_on),
             (SELECT min_by(scheduled_payment, effective_from) FROM lt WHERE lt.loan = l.loan)) AS sp
  FROM ol o JOIN ln l ON o.household_id = l.household_id AND o.merchant_normalized = l.merchant_match
  WHERE primary_category = 'fixed_obligation' AND direction <> 'inflow'),
paid AS (
  SELECT household_id, loan, annual_rate, CAST(date_trunc('month', occurred_on) AS DATE) AS month_start,
    count(*) FILTER (abs(amount) - sp >= -50) AS scheduled_count,
    sum(CASE WHEN abs(amount) - sp < -50 THEN abs(amount) WHEN abs(amount) - sp > 50 THEN abs(amount) - sp ELSE 0 END) AS extra
  FROM tier GROUP BY ALL),
pim AS (
  SELECT l.loan, CAST(m AS DATE) AS m,
    coalesce((SELECT max_by(pi, effective_from) FROM lt WHERE lt.loan = l.loan AND effective_from <= CAST(m AS DATE)),
             (SELECT min_by(pi, effective_from) FROM lt WHERE lt.loan = l.loan)) AS pi
  FROM ln l, generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH) g(m)),
roll AS (
  SELECT p.household_id, p.loan, p.month_start, p.annual_rate / 12 AS r,
    a.anchor_month AS at_month, CAST(a.balance AS DOUBLE) AS bal
  FROM paid p JOIN la a ON a.loan = p.loan AND a.anchor_month = coalesce(
    (SELECT max(anchor_month) FROM la x WHERE x.loan = p.loan AND x.anchor_month <= p.month_start),
    (SELECT min(anchor_month) FROM la x WHERE x.loan = p.loan))
  UNION ALL
  SELECT household_id, loan, month_start, r,
    CAST(CASE WHEN at_month < month_start THEN at_month + INTERVAL 1 MONTH ELSE at_month - INTERVAL 1 MONTH END AS DATE),
    CASE WHEN at_month < month_start THEN bal - ((SELECT CAST(pi AS DOUBLE) FROM pim q WHERE q.loan = roll.loan AND q.m = at_month) - bal * r)
      ELSE (bal + (SELECT CAST(pi AS DOUBLE) FROM pim q WHERE q.loan = roll.loan
        AND q.m = CAST(at_month - INTERVAL 1 MONTH AS DATE))) / (1 + r) END
  FROM roll WHERE at_month <> month_start),
princ AS (
  SELECT roll.household_id, roll.loan, month_start, round(CAST(pi AS DOUBLE) - bal * r, 2) AS principal
  FROM roll JOIN pim ON pim.loan = roll.loan AND pim.m = month_start WHERE at_month = month_start),
debt AS (
  SELECT household_id, month_start, scheduled_count,
    CAST(CAST(principal AS DECIMAL(18,2)) * scheduled_count AS DECIMAL(28,2)) AS mortgage_principal_scheduled,
    CAST(extra AS DECIMAL(28,2)) AS debt_paydown_nonscheduled,
    CAST(CAST(principal AS DECIMAL(18,2)) * scheduled_count + extra AS DECIMAL(28,2)) AS mortgage_principal
  FROM paid JOIN princ USING (household_id, loan, month_start))"""


def _debt(spark: SparkSession, d: str, ledger: DataFrame | None = None) -> DataFrame:
    return loans.debt_principal(
        L.orders_ledger(spark, d) if ledger is None else ledger, L.loans(spark, d), L.loan_tiers(spark, d), L.loan_anchors(spark, d)
    )


@query("agg8_debt_principal", "ol ln", f"""
WITH RECURSIVE {DEBT_SQL}
SELECT household_id, month_start, CAST(scheduled_count AS BIGINT) AS scheduled_count,
  CAST(mortgage_principal AS DOUBLE) AS mortgage_principal,
  CAST(mortgage_principal_scheduled AS DOUBLE) AS mortgage_principal_scheduled,
  CAST(debt_paydown_nonscheduled AS DOUBLE) AS debt_paydown_nonscheduled
FROM debt
""")
def debt_principal(spark: SparkSession, d: str) -> DataFrame:
    return doubles(_debt(spark, d), "mortgage_principal", "mortgage_principal_scheduled", "debt_paydown_nonscheduled")


@query("agg9_amortized_principal", "ol ln", f"""
WITH RECURSIVE {DEBT_SQL.replace("FROM ol o JOIN", "FROM ol o JOIN").replace(
    "paid AS (", "unused_paid AS (").replace("pim AS (", '''paid AS (
  SELECT l.household_id, l.loan, l.annual_rate, m.month_start FROM ln l JOIN
    (SELECT DISTINCT household_id, CAST(date_trunc('month', occurred_on) AS DATE) AS month_start FROM ol) m
    ON m.household_id = l.household_id),
pim AS (''').split("debt AS (")[0].rstrip().rstrip(",")}
SELECT loan, month_start, principal FROM princ
""")
def amortized(spark: SparkSession, d: str) -> DataFrame:
    months = (
        L.orders_ledger(spark, d, describe=False)
        .select("household_id", F.trunc("occurred_on", "month").alias("month_start"))
        .distinct()
        .join(L.loans(spark, d).select("household_id", "loan"), "household_id")
        .select("loan", "month_start")
    )
    out = loans.amortized_principal(L.loans(spark, d), L.loan_tiers(spark, d), L.loan_anchors(spark, d), months)
    return doubles(out, "principal")


@query("agg10_pay_deposits_investments", "ol mm", """
SELECT household_id, month_start, CAST(pay_deposits AS DOUBLE) AS pay_deposits,
  CAST(investment_outflows AS DOUBLE) AS investment_outflows FROM mm
""")
def pay_deposits(spark: SparkSession, d: str) -> DataFrame:
    out = _measures(spark, d).select("household_id", "month_start", "pay_deposits", "investment_outflows")
    return doubles(out, "pay_deposits", "investment_outflows")


@query("agg11_savings_monthly_delta", "ol ac", """
SELECT o.account_id, CAST(date_trunc('month', occurred_on) AS DATE) AS month_start, CAST(sum(amount) AS DOUBLE) AS monthly_delta
FROM ol o JOIN ac ON ac.account_id = o.account_id WHERE account_type = 'savings' GROUP BY 1, 2
""")
def savings_delta(spark: SparkSession, d: str) -> DataFrame:
    savings = L.accounts(spark, d).where("account_type = 'savings'").select("account_id")
    ledger = L.orders_ledger(spark, d, describe=False, household=False).join(savings, "account_id")
    return doubles(summaries.account_month_delta(ledger), "monthly_delta")


NORMALIZED = r"""
CASE WHEN bare = '' THEN folded ELSE bare END"""

MERCHANT_SQL = r"""
folded AS (
  SELECT *, lower(trim(regexp_replace(description_raw, '\s+', ' ', 'g'))) AS folded FROM ol),
bared AS (
  SELECT *, trim(regexp_replace(trim(regexp_replace(regexp_replace(folded,
      ' (?:al|ak|az|ar|ca|co|ct|de|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy|dc)$', ''),
      '(?:\s*(?:#|ref#?|trace#?)?\s*\d{4,}\s*)+$', '')), '[ #\-*.]+$', '')) AS bare
  FROM folded),
mk AS (
  SELECT *, CASE WHEN bare = '' THEN folded ELSE bare END AS normalized,
    coalesce(lower(nullif(trim(merchant_normalized), '')), CASE WHEN bare = '' THEN folded ELSE bare END) AS merchant_key,
    coalesce(nullif(trim(merchant_normalized), ''), array_to_string(list_transform(
      string_split(CASE WHEN bare = '' THEN folded ELSE bare END, ' '),
      lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')) AS merchant_name
  FROM bared)"""


@query("agg12_merchant_totals", "ol", f"""
WITH {MERCHANT_SQL}
SELECT household_id, CAST(date_trunc('month', occurred_on) AS DATE) AS month_start, merchant_key,
  CAST(sum(abs(amount)) AS DOUBLE) AS total, min(merchant_name) AS merchant_name
FROM mk WHERE primary_category IN ('variable_lifestyle', 'medical', 'abnormal') AND direction <> 'inflow' GROUP BY 1, 2, 3
""")
def merchant_totals(spark: SparkSession, d: str) -> DataFrame:
    return doubles(summaries.merchant_totals(L.orders_ledger(spark, d)), "total")


@query("agg13_category_breakdown", "ol", """
SELECT household_id, CAST(year AS INTEGER) AS year, primary_category, txn_count, CAST(total_usd AS DOUBLE) AS total_usd,
  CAST(row_number() OVER (PARTITION BY household_id, year ORDER BY total_usd DESC, primary_category) AS BIGINT) AS position
FROM (SELECT household_id, year(occurred_on) AS year, primary_category, count(*) AS txn_count, sum(abs(amount)) AS total_usd
  FROM ol GROUP BY ALL) x
""")
def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.category_breakdown(L.orders_ledger(spark, d, describe=False))
    return doubles(out, "total_usd").withColumn("position", F.col("position").cast("bigint"))


@query("win2_trailing_average", "ol ac", """
WITH dl AS (
  SELECT o.account_id, CAST(date_trunc('month', occurred_on) AS DATE) AS m, sum(amount) AS delta
  FROM ol o JOIN ac ON ac.account_id = o.account_id WHERE account_type = 'savings' GROUP BY 1, 2),
sp AS (
  SELECT account_id, CAST(unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS m FROM dl GROUP BY 1)
SELECT sp.account_id, sp.m AS month_start, CAST(coalesce(delta, 0) AS DOUBLE) AS monthly_delta,
  round(CAST(sum(coalesce(delta, 0)) OVER (PARTITION BY sp.account_id ORDER BY sp.m ROWS 2 PRECEDING) AS DOUBLE) / 3, 2) AS trailing_3mo_avg
FROM sp LEFT JOIN dl ON dl.account_id = sp.account_id AND dl.m = sp.m
""")
def trailing_average(spark: SparkSession, d: str) -> DataFrame:
    savings = L.accounts(spark, d).where("account_type = 'savings'").select("account_id")
    ledger = L.orders_ledger(spark, d, describe=False, household=False).join(savings, "account_id")
    return doubles(summaries.trailing_average(summaries.account_month_delta(ledger)), "monthly_delta")


MOM_SQL = """
sp AS (
  SELECT household_id, CAST(unnest(generate_series(min(month_start)::TIMESTAMP, max(month_start)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS m
  FROM mm GROUP BY 1),
dn AS (
  SELECT sp.household_id, sp.m AS month_start, coalesce(discretionary, 0) AS discretionary,
    coalesce(lag(coalesce(discretionary, 0)) OVER (PARTITION BY sp.household_id ORDER BY sp.m), 0) AS prior_month,
    sum(coalesce(discretionary, 0)) OVER (PARTITION BY sp.household_id, year(sp.m) ORDER BY sp.m) AS ytd
  FROM sp LEFT JOIN mm ON mm.household_id = sp.household_id AND mm.month_start = sp.m)"""


@query("win3_month_over_month", "ol mm", f"""
WITH {MOM_SQL}
SELECT household_id, month_start, CAST(discretionary AS DOUBLE) AS discretionary, CAST(prior_month AS DOUBLE) AS prior_month,
  CAST(discretionary - prior_month AS DOUBLE) AS mom_delta,
  CASE WHEN prior_month > 0 THEN round(CAST(discretionary - prior_month AS DOUBLE) / CAST(prior_month AS DOUBLE) * 100, 2)
    ELSE 0.0 END AS mom_delta_pct
FROM dn
""")
def month_over_month(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.month_over_month(_measures(spark, d)).drop("ytd", "ytd_annualized")
    return doubles(out, "discretionary", "prior_month", "mom_delta")


@query("win4_year_to_date", "ol mm", f"""
WITH {MOM_SQL}
SELECT household_id, month_start, CAST(ytd AS DOUBLE) AS ytd, CAST((CAST(ytd * 100 AS HUGEINT) * 24 + month(month_start)) // (2 * month(month_start)) AS DOUBLE) / 100 AS ytd_annualized
FROM dn
""")
def year_to_date(spark: SparkSession, d: str) -> DataFrame:
    return doubles(summaries.month_over_month(_measures(spark, d)).select("household_id", "month_start", "ytd", "ytd_annualized"), "ytd")


@query("win6_top_movers", "ol", f"""
WITH {MERCHANT_SQL},
t AS (
  SELECT household_id, CAST(date_trunc('month', occurred_on) AS DATE) AS m, merchant_key, sum(abs(amount)) AS total,
    min(merchant_name) AS nm
  FROM mk WHERE primary_category IN ('variable_lifestyle', 'medical', 'abnormal') AND direction <> 'inflow' GROUP BY 1, 2, 3),
lastm AS (SELECT household_id, max(m) AS last_m FROM t GROUP BY 1),
p AS (SELECT household_id, CAST(m + INTERVAL 1 MONTH AS DATE) AS m, merchant_key, total, nm FROM t),
b AS (
  SELECT coalesce(t.household_id, p.household_id) AS household_id, coalesce(t.m, p.m) AS month_start,
    coalesce(t.merchant_key, p.merchant_key) AS merchant_key, coalesce(t.nm, p.nm) AS merchant,
    coalesce(t.total, 0) AS this_month, coalesce(p.total, 0) AS prior_month
  FROM t FULL OUTER JOIN p ON t.household_id = p.household_id AND t.m = p.m AND t.merchant_key = p.merchant_key),
r AS (
  SELECT b.*, this_month - prior_month AS delta, prior_month <= 0 AS is_new,
    row_number() OVER (PARTITION BY b.household_id, month_start
      ORDER BY abs(this_month - prior_month) DESC, this_month DESC, merchant_key) AS position
  FROM b JOIN lastm ON lastm.household_id = b.household_id AND month_start <= last_m
  WHERE CASE WHEN prior_month <= 0 THEN this_month >= 300
    ELSE prior_month >= 100 AND abs(this_month - prior_month) >= 200 END)
SELECT household_id, month_start, merchant_key, merchant, CAST(this_month AS DOUBLE) AS this_month,
  CAST(prior_month AS DOUBLE) AS prior_month, CAST(delta AS DOUBLE) AS delta, is_new, CAST(position AS BIGINT) AS position
FROM r WHERE position <= 3
""")
def top_movers(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.top_movers(summaries.merchant_totals(L.orders_ledger(spark, d)))
    return doubles(out, "this_month", "prior_month", "delta").withColumn("position", F.col("position").cast("bigint"))


BALANCE_SQL = """
newest_anchor AS (
  SELECT account_id, max(as_of) AS as_of, arg_max(balance, as_of) AS balance
  FROM (SELECT account_id, as_of, balance FROM an UNION ALL SELECT account_id, as_of, balance FROM cp) GROUP BY 1),
bal AS (
  SELECT ac.account_id, account_type, an.as_of AS anchor_date, an.balance AS anchor_balance,
    CASE WHEN an.as_of IS NOT NULL THEN coalesce((SELECT sum(effect) FROM ol
      WHERE ol.account_id = ac.account_id AND occurred_on > an.as_of AND occurred_on <= DATE '2001-08-01'), 0)
      * CASE WHEN account_type = 'credit_card' THEN -1 ELSE 1 END END AS net
  FROM ac LEFT JOIN newest_anchor an ON an.account_id = ac.account_id)"""


def stored_openings(spark: SparkSession, d: str) -> DataFrame:
    """The opening anchors and the dated closings seeded as stored periods."""
    anchors = balances.config_anchors(
        L.accounts(spark, d), L.opening_anchors(spark, d), L.checkpoints(spark, d), L.OPENING_DAY
    )
    return balances.seed_anchors(balances.empty_periods(spark), anchors).drop("action")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False)
    held = balances.computed_balances(ledger, L.accounts(spark, d), stored_openings(spark, d), L.AS_OF)
    return summaries.monthly_summary(
        ledger, L.goal_accounts(spark, d), held.select("account_id", "computed_balance"), L.household_params(spark, d), _debt(spark, d)
    )


SUMMARY_SQL = f"""
{DEBT_SQL},
{BALANCE_SQL},
sp AS (
  SELECT household_id, CAST(unnest(generate_series(min(month_start)::TIMESTAMP, max(month_start)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month_start
  FROM mm GROUP BY 1),
gd AS (
  SELECT o.household_id, CAST(date_trunc('month', occurred_on) AS DATE) AS month_start, sum(amount) AS delta
  FROM ol o JOIN ga ON ga.account_id = o.account_id AND ga.household_id = o.household_id GROUP BY 1, 2),
gb AS (SELECT ga.household_id, coalesce(anchor_balance + net, 0) AS goal_balance FROM ga JOIN bal ON bal.account_id = ga.account_id),
j AS (
  SELECT sp.household_id, sp.month_start, coalesce(row_count, 0) AS row_count, coalesce(inflows, 0) AS inflows,
    coalesce(fixed_obligations, 0) AS fixed_obligations, coalesce(discretionary, 0) AS discretionary,
    coalesce(income_offsets, 0) AS income_offsets, coalesce(spend_offsets, 0) AS spend_offsets,
    coalesce(pay_deposits, 0) AS pay_deposits, coalesce(investment_outflows, 0) AS investment_outflows,
    coalesce(delta, 0) AS monthly_delta, coalesce(mortgage_principal, 0) AS mortgage_principal,
    coalesce(mortgage_principal_scheduled, 0) AS mortgage_principal_scheduled,
    coalesce(debt_paydown_nonscheduled, 0) AS debt_paydown_nonscheduled, coalesce(goal_balance, 0) AS goal_balance, hp.* EXCLUDE household_id
  FROM sp LEFT JOIN mm ON mm.household_id = sp.household_id AND mm.month_start = sp.month_start
    LEFT JOIN gd ON gd.household_id = sp.household_id AND gd.month_start = sp.month_start
    LEFT JOIN debt ON debt.household_id = sp.household_id AND debt.month_start = sp.month_start
    JOIN hp ON hp.household_id = sp.household_id LEFT JOIN gb ON gb.household_id = sp.household_id),
w AS (
  SELECT *, round(CAST(sum(monthly_delta) OVER (PARTITION BY household_id ORDER BY month_start ROWS 2 PRECEDING) AS DOUBLE) / 3, 2) AS trail,
    coalesce(lag(discretionary) OVER (PARTITION BY household_id ORDER BY month_start), 0) AS prior_disc,
    sum(discretionary) OVER (PARTITION BY household_id, year(month_start) ORDER BY month_start) AS ytd,
    inflows - fixed_obligations - discretionary AS net_fcf, inflows - income_offsets AS earned,
    fixed_obligations + discretionary - income_offsets - spend_offsets - mortgage_principal AS net_consumption,
    retirement_a + retirement_b + hsa AS advantaged,
    round(CAST(goal_target AS DOUBLE) - CAST(goal_balance AS DOUBLE), 2) AS gap
  FROM j),
summary AS (
  SELECT *, CASE WHEN inflows > 0 THEN round(CAST(monthly_delta AS DOUBLE) / CAST(inflows AS DOUBLE) * 100, 2) ELSE 0.0 END AS rate,
    gross_monthly - advantaged - pay_deposits AS implied,
    round(CAST(advantaged + monthly_delta + investment_outflows AS DOUBLE) / CAST(gross_monthly AS DOUBLE) * 100, 2) AS theo_rate,
    CASE WHEN gap <= 0 THEN 'reached' WHEN trail <= 0 THEN 'indefinite' ELSE 'projected' END AS status,
    CASE WHEN gap <= 0 THEN 0 WHEN trail > 0 THEN CAST(ceil((CAST(goal_target AS DOUBLE) - CAST(goal_balance AS DOUBLE)) / trail) AS INTEGER) END AS left_months
  FROM w)"""


@query("sum1_monthly_summary", "ol mm ac an cp ga hp ln", f"""
WITH RECURSIVE {SUMMARY_SQL}
SELECT household_id, month_start, CAST(row_count AS BIGINT) AS row_count, CAST(goal_balance AS DOUBLE) AS goal_balance, gap,
  CAST(monthly_delta AS DOUBLE) AS monthly_delta, trail AS trailing_3mo_avg, status AS projection_status,
  left_months AS months_remaining,
  CAST(last_day(CAST(month_start + to_months(left_months) AS DATE)) AS DATE) AS projected_hit_date,
  CAST(inflows AS DOUBLE) AS inflows, CAST(fixed_obligations AS DOUBLE) AS fixed_obligations,
  CAST(discretionary AS DOUBLE) AS discretionary, CAST(net_fcf AS DOUBLE) AS net_fcf, rate AS savings_rate_pct,
  CAST(earned AS DOUBLE) AS earned_income, CAST(income_offsets + spend_offsets AS DOUBLE) AS reimbursements,
  CAST(mortgage_principal AS DOUBLE) AS mortgage_principal, CAST(net_consumption AS DOUBLE) AS net_consumption,
  CAST(prior_disc AS DOUBLE) AS prior_discretionary, CAST(discretionary - prior_disc AS DOUBLE) AS mom_delta,
  CASE WHEN prior_disc > 0 THEN round(CAST(discretionary - prior_disc AS DOUBLE) / CAST(prior_disc AS DOUBLE) * 100, 2) ELSE 0.0 END AS mom_delta_pct,
  CAST(ytd AS DOUBLE) AS ytd_discretionary, CAST((CAST(ytd * 100 AS HUGEINT) * 24 + month(month_start)) // (2 * month(month_start)) AS DOUBLE) / 100 AS ytd_annualized
FROM summary
""")
def monthly_summary(spark: SparkSession, d: str) -> DataFrame:
    money = [
        "goal_balance", "monthly_delta", "inflows", "fixed_obligations", "discretionary", "net_fcf", "earned_income",
        "reimbursements", "mortgage_principal", "net_consumption", "prior_discretionary", "mom_delta", "ytd_discretionary",
    ]
    out = _summary(spark, d).withColumn("row_count", F.col("row_count").cast("bigint"))
    return doubles(out, *money).select(
        "household_id", "month_start", "row_count", "gap", "trailing_3mo_avg", "projection_status", "months_remaining",
        "projected_hit_date", "savings_rate_pct", "mom_delta_pct", "ytd_annualized", *money,
    )


@query("sum2_theoretical_savings", "ol mm ac an cp ga hp ln", f"""
WITH RECURSIVE {SUMMARY_SQL}
SELECT household_id, month_start, CAST(greatest(implied, 0) AS DOUBLE) AS implied_withholding, implied < 0 AS withholding_floored,
  CAST(advantaged + monthly_delta + investment_outflows AS DOUBLE) AS theoretical_savings, theo_rate AS theoretical_rate_pct,
  round(theo_rate - 22.0::DOUBLE, 2) AS delta_vs_target_pct, (retirement_a = 0 OR retirement_b = 0) AS params_incomplete
FROM summary
""")
def theoretical_savings(spark: SparkSession, d: str) -> DataFrame:
    out = _summary(spark, d).select(
        "household_id", "month_start", "implied_withholding", "withholding_floored", "theoretical_savings",
        "theoretical_rate_pct", "delta_vs_target_pct", "params_incomplete",
    )
    return doubles(out, "implied_withholding", "theoretical_savings")


@query("sum3_summary_flags", "ol mm ac an cp ga hp ln", f"""
WITH RECURSIVE {SUMMARY_SQL}, {MERCHANT_SQL}
SELECT household_id, month_start, 'savings_rate_below_floor' AS code, 'warn' AS severity, CAST(NULL AS VARCHAR) AS merchant,
  CAST(NULL AS DATE) AS occurred_on, rate AS value FROM summary WHERE rate < 18
UNION ALL SELECT household_id, month_start, 'discretionary_over_ceiling', 'warn', NULL, NULL, CAST(discretionary AS DOUBLE)
FROM summary WHERE discretionary > 500000
UNION ALL SELECT household_id, month_start, 'implied_withholding_negative', 'warn', NULL, NULL, CAST(implied AS DOUBLE)
FROM summary WHERE implied < 0
UNION ALL SELECT household_id, CAST(date_trunc('month', occurred_on) AS DATE), 'abnormal_outflow', 'alert', merchant_name, occurred_on,
  CAST(abs(amount) AS DOUBLE) FROM mk WHERE primary_category = 'abnormal' AND abs(amount) > 300000
""")
def summary_flags(spark: SparkSession, d: str) -> DataFrame:
    return summaries.summary_flags(_summary(spark, d), L.orders_ledger(spark, d))


@query("sum4_identity_check", "ol mm ac an cp ga hp ln", f"""
WITH RECURSIVE {SUMMARY_SQL}
SELECT household_id, month_start, CAST((earned - net_consumption) - (net_fcf + mortgage_principal + spend_offsets) AS DOUBLE) AS residual,
  (earned - net_consumption) = (net_fcf + mortgage_principal + spend_offsets) AS holds FROM summary
""")
def identity_check(spark: SparkSession, d: str) -> DataFrame:
    return doubles(summaries.identity_check(_summary(spark, d)), "residual")


@query("agg14_annual_summary", "ol mm ac an cp ga hp ln", f"""
WITH RECURSIVE {SUMMARY_SQL}
SELECT household_id, CAST(year(month_start) AS INTEGER) AS year, strftime(month_start, '%Y-%m') AS month,
  CASE WHEN grouping(strftime(month_start, '%Y-%m')) = 1 THEN 'total' ELSE 'month' END AS kind,
  CAST(sum(inflows) AS DOUBLE) AS inflows, CAST(sum(fixed_obligations) AS DOUBLE) AS fixed_obligations,
  CAST(sum(discretionary) AS DOUBLE) AS discretionary, CAST(sum(net_fcf) AS DOUBLE) AS net_fcf,
  CAST(sum(earned) AS DOUBLE) AS earned_income, CAST(sum(income_offsets + spend_offsets) AS DOUBLE) AS reimbursements,
  CAST(sum(income_offsets) AS DOUBLE) AS reimbursements_income_side, CAST(sum(spend_offsets) AS DOUBLE) AS reimbursements_spend_side,
  CAST(sum(mortgage_principal) AS DOUBLE) AS mortgage_principal,
  CAST(sum(mortgage_principal_scheduled) AS DOUBLE) AS mortgage_principal_scheduled,
  CAST(sum(debt_paydown_nonscheduled) AS DOUBLE) AS debt_paydown_nonscheduled, CAST(sum(net_consumption) AS DOUBLE) AS net_consumption
FROM summary WHERE row_count > 0
GROUP BY GROUPING SETS ((household_id, year(month_start), strftime(month_start, '%Y-%m')), (household_id, year(month_start)))
""")
def annual_summary(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.annual_summary(_summary(spark, d))
    return doubles(out, "inflows", "fixed_obligations", "discretionary", "net_fcf", *summaries.CONSUMPTION_FIELDS)


@query("sum6_summary_drift", "ol mm ac an cp ga hp ln", f"""
WITH RECURSIVE {SUMMARY_SQL},
now_rows AS (SELECT *, year(month_start) * 12 + month(month_start) - 1 AS ix FROM summary),
lng AS (
  SELECT household_id, strftime(month_start, '%Y-%m') AS label, ix, f.field,
    CASE f.field WHEN 'inflows' THEN inflows WHEN 'fixed_obligations' THEN fixed_obligations WHEN 'discretionary' THEN discretionary
      WHEN 'net_fcf' THEN net_fcf WHEN 'net_consumption' THEN net_consumption
      WHEN 'mortgage_principal_scheduled' THEN mortgage_principal_scheduled ELSE debt_paydown_nonscheduled END AS computed
  FROM now_rows, (VALUES ('inflows'), ('fixed_obligations'), ('discretionary'), ('net_fcf'), ('net_consumption'),
    ('mortgage_principal_scheduled'), ('debt_paydown_nonscheduled')) f(field) WHERE ix % 6 <> 0),
st AS (
  SELECT *, CASE WHEN field = 'inflows' AND ix % 4 = 0 THEN computed + 10
    WHEN field = 'net_consumption' AND ix % 9 = 0 THEN NULL ELSE computed END AS stored FROM lng)
SELECT household_id, label, field, CAST(stored AS DOUBLE) AS stored, CAST(computed AS DOUBLE) AS computed,
  CAST(computed - stored AS DOUBLE) AS delta,
  CASE WHEN stored IS NULL THEN 'absent from the stored summary' ELSE 'differs' END AS note
FROM st WHERE stored IS NULL OR stored <> computed
""")
def summary_drift(spark: SparkSession, d: str) -> DataFrame:
    fresh = _summary(spark, d)
    stored = L.stored_summaries(spark, d, fresh)
    recomputed = fresh.withColumn("label", S.month_label("month_start"))
    return doubles(summaries.summary_drift(stored, recomputed), "stored", "computed", "delta")


@query("set2_months_present", "ol", "SELECT DISTINCT household_id, strftime(occurred_on, '%Y-%m') AS month FROM ol")
def months_present(spark: SparkSession, d: str) -> DataFrame:
    return summaries.months_present(L.orders_ledger(spark, d, describe=False))


@query("set3_months_without_summary", "ol", """
WITH m AS (SELECT DISTINCT household_id, strftime(occurred_on, '%Y-%m') AS label FROM ol),
l AS (SELECT * FROM m UNION SELECT DISTINCT household_id, substr(label, 1, 4) FROM m)
SELECT household_id, label FROM l
WHERE length(label) = 4 OR CAST(substr(label, 6, 2) AS INTEGER) IN (1, 7)
""")
def months_without_summary(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False)
    stored = (
        ledger.where(~F.month("occurred_on").isin(1, 7))
        .select("household_id", S.month_label("occurred_on").alias("label"))
        .distinct()
    )
    return summaries.months_without_summary(ledger, stored)


@query("agg21_annual_reference_ratios", "", """
WITH g AS (
  SELECT c_nationkey, CAST(1995 + c_custkey % 7 AS INTEGER) AS year, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS g
  FROM customer GROUP BY 1, 2),
r AS (
  SELECT 'hh-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS household_id, year, CAST(g * 3 AS DECIMAL(18,2)) AS gross,
    CAST(round(g * 0.1, 2) AS DECIMAL(18,2)) + CAST(round(g * 0.05, 2) AS DECIMAL(18,2)) + CAST(round(g * 0.025, 2) AS DECIMAL(18,2)) AS withheld,
    CAST(round(g * 0.02, 2) AS DECIMAL(18,2)) + CAST(round(g * 0.01, 2) AS DECIMAL(18,2)) * 2 AS deferred
  FROM g WHERE (c_nationkey + year) % 5 <> 0 AND g <> 0)
SELECT household_id, year, CAST(gross AS DOUBLE) AS gross_total, CAST(withheld AS DOUBLE) AS withholding_total,
  CAST(deferred AS DOUBLE) AS pretax_deferrals_total, CAST(gross - withheld - deferred AS DOUBLE) AS net_take_home_estimate,
  CASE WHEN gross > 0 THEN round(CAST(withheld AS DOUBLE) / CAST(gross AS DOUBLE) * 100, 2) END AS effective_tax_rate_pct,
  CASE WHEN gross > 0 THEN round(CAST(gross - withheld - deferred AS DOUBLE) / CAST(gross AS DOUBLE), 4) END AS gross_to_net_ratio,
  CASE WHEN gross > 0 THEN round(CAST(deferred AS DOUBLE) / CAST(gross AS DOUBLE) * 100, 2) END AS pretax_savings_rate_pct, '' AS notes
FROM r
""")
def annual_reference(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.annual_reference_ratios(L.annual_reference(spark, d))
    return doubles(out, "gross_total", "withholding_total", "pretax_deferrals_total", "net_take_home_estimate")

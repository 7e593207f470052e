"""Balances, chains, checkpoints and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators import balances, chains, loans
from tallyframe.operators.common import spread
from tallyframe.plans.catalog.summaries import BALANCE_SQL, doubles, stored_openings
from tallyframe.plans.registry import query
from tallyframe.sources import sample_ledger as L

START, END = "1995-01-01", "2001-08-01"


@query("agg17_period_flows", "ol ac", """
SELECT account_id, CAST(date_trunc('month', occurred_on) AS DATE) AS period_start,
  CAST(coalesce(sum(amount) FILTER (direction = 'inflow'), 0) AS DOUBLE) AS inflows,
  CAST(coalesce(sum(abs(amount)) FILTER (direction = 'outflow'), 0) AS DOUBLE) AS outflows,
  CAST(coalesce(sum(amount) FILTER (direction = 'transfer' AND amount >= 0), 0) AS DOUBLE) AS transfers_in,
  CAST(coalesce(sum(abs(amount)) FILTER (direction = 'transfer' AND amount < 0), 0) AS DOUBLE) AS transfers_out,
  CAST(sum(effect) AS DOUBLE) AS net
FROM ol GROUP BY 1, 2
""")
def period_flows(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False, household=False)
    months = ledger.select("account_id", F.trunc("occurred_on", "month").alias("period_start")).distinct()
    periods = months.withColumn("period_end", F.last_day("period_start"))
    out = balances.period_breakdown(ledger, periods).drop("period_end")
    return doubles(out, "inflows", "outflows", "transfers_in", "transfers_out", "net")


@query("bal1_computed_balance", "ol ac an cp", f"""
WITH {BALANCE_SQL}
SELECT account_id, account_type, anchor_date, CAST(anchor_balance AS DOUBLE) AS anchor_balance, CAST(net AS DOUBLE) AS net_since_anchor,
  CAST(anchor_balance + net AS DOUBLE) AS computed_balance, DATE '2001-08-01' AS as_of_date FROM bal
""")
def computed_balance(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False, household=False)
    out = balances.computed_balances(ledger, L.accounts(spark, d), stored_openings(spark, d), L.AS_OF)
    return doubles(out, "anchor_balance", "net_since_anchor", "computed_balance")


def _stored_before_seeding(spark: SparkSession, d: str) -> DataFrame:
    """Opening-day periods of two thirds of the accounts: a third skeletons, a sixth evidence, the rest configured."""
    k = F.substring("account_id", 6, L.ID_WIDTH).cast("bigint")
    base = balances.config_anchors(L.accounts(spark, d), L.opening_anchors(spark, d), L.checkpoints(spark, d).where("1 = 0"), L.OPENING_DAY)
    rows = base.withColumn("k", k).where("k % 3 <> 2")
    stored = balances.seed_anchors(balances.empty_periods(spark), base).drop("action", "statement_closing", "closing_source")
    held = rows.select(
        "account_id",
        F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.coalesce("closing", F.lit(0)) + 5).cast("decimal(18,2)").alias("statement_closing"),
        F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("k") % 2 == 0, "running_balance").otherwise("opening_seed").alias("closing_source"),
    )
    return stored.join(held, "account_id").select(*balances.empty_periods(spark).columns)


@query("bal2_seed_anchors", "ac an cp", """
WITH want AS (
  SELECT ac.account_id, DATE '1994-12-31' AS period_end, an.balance AS closing, CASE WHEN an.balance IS NOT NULL THEN 'opening_seed' END AS src, ac.k
  FROM ac LEFT JOIN an ON an.account_id = ac.account_id
  UNION ALL SELECT account_id, as_of, balance, 'statement', NULL FROM cp),
st AS (
  SELECT account_id, CASE WHEN k % 3 = 0 THEN NULL ELSE coalesce(closing, 0) + 5 END AS closing,
    CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 'running_balance' ELSE 'opening_seed' END AS src FROM want WHERE k % 3 <> 2),
m AS (
  SELECT w.*, s.closing AS had, s.src AS had_src, CASE WHEN s.account_id IS NULL THEN 'insert' WHEN w.closing IS NOT NULL AND s.closing IS NULL THEN 'fill'
    WHEN w.closing IS NOT NULL AND s.src = 'opening_seed' AND w.closing <> s.closing THEN 'follow' ELSE 'keep' END AS action
  FROM want w LEFT JOIN st s ON s.account_id = w.account_id AND w.k IS NOT NULL)
SELECT account_id, period_end, action, CAST(CASE WHEN action = 'keep' THEN had ELSE closing END AS DOUBLE) AS statement_closing,
  CASE WHEN action IN ('insert', 'fill') THEN src ELSE had_src END AS closing_source FROM m
""")
def seed_anchors(spark: SparkSession, d: str) -> DataFrame:
    wanted = balances.config_anchors(L.accounts(spark, d), L.opening_anchors(spark, d), L.checkpoints(spark, d), L.OPENING_DAY)
    out = balances.seed_anchors(_stored_before_seeding(spark, d), wanted)
    return doubles(out.select("account_id", "period_end", "action", "statement_closing", "closing_source"), "statement_closing")


def _goals(spark: SparkSession, d: str) -> DataFrame:
    return L.household_params(spark, d).select(
        "household_id", F.concat(F.lit("gate-"), "household_id").alias("gate_key"), F.lit(1).cast("decimal(18,2)").alias("current_amount"),
        F.col("goal_target").alias("target_amount"),
    )


@query("bal3_refresh_goals", "ol ac an cp ga hp", f"""
WITH {BALANCE_SQL}
SELECT 'gate-' || hp.household_id AS gate_key, CAST(coalesce(anchor_balance + net, 1) AS DOUBLE) AS current_amount,
  CAST(goal_target AS DOUBLE) AS target_amount, anchor_balance IS NOT NULL AS updated
FROM hp LEFT JOIN ga ON ga.household_id = hp.household_id LEFT JOIN bal ON bal.account_id = ga.account_id
""")
def refresh_goals(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False, household=False)
    held = balances.computed_balances(ledger, L.accounts(spark, d), stored_openings(spark, d), L.AS_OF)
    links = L.goal_accounts(spark, d).select(F.concat(F.lit("gate-"), "household_id").alias("gate_key"), "account_id")
    out = balances.refresh_goals(_goals(spark, d), links, held)
    return doubles(out.select("gate_key", "current_amount", "target_amount", "updated"), "current_amount", "target_amount")


# --- running balances --------------------------------------------------------


def chain_rows(spark: SparkSession, d: str) -> DataFrame:
    """Running balances with faults: every 97th balance off by a cent, every 50th row without one."""
    n = F.substring("id", 2, L.ID_WIDTH).cast("bigint")
    faulty = F.when(n % 97 == 0, F.col("running_balance") + 0.01).otherwise(F.col("running_balance"))
    return L.balance_rows(spark, d).withColumn("running_balance", F.when(n % 50 != 3, faulty).cast("decimal(18,2)"))


CHAIN_SQL = """
WITH RECURSIVE cr AS (
  SELECT account_id, id, occurred_on AS d, CAST(amount * 100 AS BIGINT) AS a,
    CASE WHEN CAST(substr(id, 2) AS BIGINT) % 50 = 3 THEN NULL ELSE CAST(running_balance * 100 AS BIGINT)
      + CASE WHEN CAST(substr(id, 2) AS BIGINT) % 97 = 0 THEN 1 ELSE 0 END END AS b
  FROM bl),
cx AS (SELECT account_id, d, id, b, b - a AS p FROM cr WHERE b IS NOT NULL),
nx AS (
  SELECT x.account_id, x.d, x.id, count(y.id) AS succ, min(y.id) AS nxt FROM cx x LEFT JOIN cx y
    ON y.account_id = x.account_id AND y.d = x.d AND y.id <> x.id AND y.p = x.b GROUP BY 1, 2, 3),
pv AS (
  SELECT x.account_id, x.d, x.id, count(y.id) AS pred FROM cx x LEFT JOIN cx y
    ON y.account_id = x.account_id AND y.d = x.d AND y.id <> x.id AND y.b = x.p GROUP BY 1, 2, 3),
sh AS (
  SELECT nx.account_id, nx.d, count(*) AS n, max(succ) AS ms, max(pred) AS mp, count(*) FILTER (succ = 0) AS terms,
    count(*) FILTER (pred = 0) AS heads, min(nx.id) FILTER (pred = 0) AS head, min(nx.id) FILTER (succ = 0) AS term
  FROM nx JOIN pv ON pv.id = nx.id GROUP BY 1, 2),
wk AS (
  SELECT account_id, d, head AS at, 1 AS steps FROM sh WHERE ms <= 1 AND mp <= 1 AND terms = 1 AND heads = 1
  UNION ALL SELECT wk.account_id, wk.d, nxt, steps + 1 FROM wk JOIN nx ON nx.id = wk.at WHERE nxt IS NOT NULL AND steps < 1000),
ln AS (SELECT account_id, d, max(steps) AS steps FROM wk GROUP BY 1, 2),
dc AS (
  SELECT sh.account_id, sh.d, n, sh.n > 1 AND (ln.steps IS NULL OR ln.steps <> sh.n) AS ambiguous,
    (SELECT max(b) FROM cx WHERE cx.account_id = sh.account_id AND cx.d = sh.d) AS high,
    (SELECT p FROM cx WHERE cx.id = head) AS opening, (SELECT b FROM cx WHERE cx.id = term) AS closing
  FROM sh LEFT JOIN ln ON ln.account_id = sh.account_id AND ln.d = sh.d)"""


@query("win11_intraday_chain", "bl", CHAIN_SQL + """
SELECT account_id, d AS occurred_on, n AS row_count, ambiguous, CASE WHEN NOT ambiguous THEN CAST(opening AS DOUBLE) / 100 END AS opening,
  CASE WHEN NOT ambiguous THEN CAST(closing AS DOUBLE) / 100 END AS closing, CAST(high AS DOUBLE) / 100 AS highest_balance FROM dc
""")
def intraday(spark: SparkSession, d: str) -> DataFrame:
    return doubles(chains.intraday_chains(chain_rows(spark, d)), "opening", "closing", "highest_balance")


@query("bal4_statement_closing", "bl", CHAIN_SQL + """,
ad AS (SELECT account_id, d, count(b) AS nb FROM cr GROUP BY 1, 2),
pe AS (SELECT account_id, e AS period_end FROM (SELECT DISTINCT account_id FROM cr) x, (VALUES (DATE '2024-01-10'), (DATE '2024-01-31'), (DATE '2024-02-29')) v(e)),
lt AS (SELECT pe.account_id, period_end, max(d) AS d FROM pe LEFT JOIN ad ON ad.account_id = pe.account_id AND d <= period_end GROUP BY 1, 2)
SELECT lt.account_id, period_end, lt.d AS closing_day, CAST(CASE WHEN ambiguous THEN high ELSE closing END AS DOUBLE) / 100 AS closing,
  CASE WHEN dc.d IS NULL THEN NULL WHEN ambiguous THEN 'running_balance_unresolved' ELSE 'running_balance' END AS closing_source
FROM lt LEFT JOIN dc ON dc.account_id = lt.account_id AND dc.d = lt.d
""")
def statement_closing(spark: SparkSession, d: str) -> DataFrame:
    rows = chain_rows(spark, d)
    ends = F.array(*[F.lit(e).cast("date") for e in ("2024-01-10", "2024-01-31", "2024-02-29")])
    points = rows.select("account_id").distinct().select("account_id", F.explode(ends).alias("period_end"))
    return doubles(chains.statement_closings(points, rows), "closing")


@query("win12_month_boundary_chain", "bl", CHAIN_SQL.replace("% 50 = 3", "% 100000 = 100001") + """,
fl AS (SELECT account_id, CAST(date_trunc('week', d) AS DATE) AS w, min(d) AS f, max(d) AS l FROM dc GROUP BY 1, 2),
mo AS (
  SELECT fl.account_id, w AS month_start, f AS first_day, l AS last_day, CASE WHEN NOT a.ambiguous THEN a.opening END AS opening,
    CASE WHEN NOT b.ambiguous THEN b.closing END AS closing, a.ambiguous AS opening_ambiguous, b.ambiguous AS closing_ambiguous
  FROM fl JOIN dc a ON a.account_id = fl.account_id AND a.d = f JOIN dc b ON b.account_id = fl.account_id AND b.d = l)
SELECT account_id, first_day, last_day, CAST(opening AS DOUBLE) / 100 AS opening, CAST(closing AS DOUBLE) / 100 AS closing, opening_ambiguous,
  closing_ambiguous, CAST(lag(closing) OVER w AS DOUBLE) / 100 AS prior_closing, coalesce(opening <> lag(closing) OVER w, false) AS broken
FROM mo WINDOW w AS (PARTITION BY account_id ORDER BY month_start)
""")
def month_boundary(spark: SparkSession, d: str) -> DataFrame:
    """The events span one month, so weeks play the months: each week is moved to a month of its own."""
    n = F.substring("id", 2, L.ID_WIDTH).cast("bigint")
    week = F.floor(F.datediff("occurred_on", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    weekday = F.datediff("occurred_on", F.trunc("occurred_on", "week"))
    moved = F.date_add(F.add_months(F.lit("2024-01-01").cast("date"), week), weekday)
    faulty = F.when(n % 97 == 0, F.col("running_balance") + 0.01).otherwise(F.col("running_balance")).cast("decimal(18,2)")
    rows = L.balance_rows(spark, d).withColumn("running_balance", faulty).withColumn("occurred_on", moved)
    out = chains.month_chains(rows)

    def back(day: str):
        index = S.month_index("month_start") - 2024 * 12
        return F.date_add(F.lit("2024-01-01").cast("date"), (index * 7 + F.datediff(F.col(day), F.col("month_start"))).cast("int"))

    out = out.withColumns({"first_day": back("first_day"), "last_day": back("last_day")})
    return doubles(out.drop("month_start", "prior_month"), "opening", "closing", "prior_closing")


@query("ver13_partly_balanced_accounts", "bl", """
SELECT account_id FROM bl GROUP BY 1 HAVING count(*) FILTER (CAST(substr(id, 2) AS BIGINT) % 50 = 3) BETWEEN 1 AND count(*) - 1
""")
def partly(spark: SparkSession, d: str) -> DataFrame:
    return chains.partly_balanced_accounts(chain_rows(spark, d))


# --- reconciliation ----------------------------------------------------------

RECON_SQL = """
WITH RECURSIVE rb AS (
  SELECT account_id, occurred_on AS d, CASE WHEN count(*) OVER (PARTITION BY account_id, occurred_on) = 1
    THEN CAST(100 + sum(amount) OVER (PARTITION BY account_id ORDER BY occurred_on, id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) END AS b
  FROM ol WHERE CAST(substr(account_id, 6) AS BIGINT) % 7 = 1),
hb AS (SELECT account_id FROM rb GROUP BY 1 HAVING count(b) > 0),
mo AS (
  SELECT CAST(m AS DATE) AS ps, least(last_day(CAST(m AS DATE)), DATE '2001-08-01') AS pe
  FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) g(m)),
gov AS (
  SELECT cp.account_id, CAST(date_trunc('month', as_of) AS DATE) AS ps, max(as_of) AS g, max_by(balance, as_of) AS x
  FROM cp JOIN ac ON ac.account_id = cp.account_id AND account_type <> 'credit_card' WHERE cp.account_id NOT IN (SELECT account_id FROM hb) GROUP BY 1, 2),
am AS (SELECT ac.account_id, account_type, ac.k, mo.ps, mo.pe, g, x FROM ac CROSS JOIN mo LEFT JOIN gov ON gov.account_id = ac.account_id AND gov.ps = mo.ps),
pr AS (
  SELECT account_id, account_type, k, CASE WHEN g = ps THEN CAST(g + 1 AS DATE) ELSE ps END AS s, CASE WHEN g > ps AND g < pe THEN g ELSE pe END AS e,
    CASE WHEN g = ps THEN 'remainder' WHEN g IS NOT NULL THEN 'verify' ELSE 'plain' END AS role,
    CASE WHEN g = ps THEN x END AS own, CASE WHEN g > ps THEN x END AS fixed FROM am
  UNION ALL SELECT account_id, account_type, k, CAST(g + 1 AS DATE), pe, 'remainder', x, NULL FROM am WHERE g > ps AND g < pe),
ex AS (
  SELECT pr.*, (SELECT balance FROM cp WHERE cp.account_id = pr.account_id AND as_of = e AND (pr.account_type = 'credit_card' OR pr.account_id IN (SELECT account_id FROM hb))) AS given,
    (SELECT any_value(b) FROM rb WHERE rb.account_id = pr.account_id AND d = (SELECT max(d) FROM rb q WHERE q.account_id = pr.account_id AND q.d <= e)) AS derived
  FROM pr),
sq AS (
  SELECT pr.* EXCLUDE (given, derived), row_number() OVER (PARTITION BY account_id ORDER BY s) AS i, coalesce(fixed, given, derived) AS closing,
    CASE WHEN fixed IS NOT NULL THEN 'checkpoint' WHEN given IS NOT NULL THEN 'statement' WHEN derived IS NOT NULL THEN 'running_balance' END AS src,
    coalesce((SELECT sum(effect) FROM ol WHERE ol.account_id = pr.account_id AND occurred_on BETWEEN s AND e), 0) AS net
  FROM ex pr),
rc AS (
  SELECT sq.*, coalesce(own, an.balance) AS opening,
    CAST(coalesce(own, an.balance) + net * CASE account_type WHEN 'credit_card' THEN -1 ELSE 1 END AS DECIMAL(28,2)) AS computed
  FROM sq LEFT JOIN an ON an.account_id = sq.account_id WHERE i = 1
  UNION ALL
  SELECT sq.*, coalesce(sq.own, rc.closing, rc.computed),
    CAST(coalesce(sq.own, rc.closing, rc.computed) + sq.net * CASE sq.account_type WHEN 'credit_card' THEN -1 ELSE 1 END AS DECIMAL(28,2))
  FROM rc JOIN sq ON sq.account_id = rc.account_id AND sq.i = rc.i + 1)"""


def with_running_balances(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every seventh account carries running balances, on the days with one row; the others carry none."""
    carries = F.coalesce(F.substring("account_id", 6, L.ID_WIDTH).cast("bigint") % 7 == 1, F.lit(False))
    so_far = Window.partitionBy("account_id").orderBy("occurred_on", "id").rowsBetween(Window.unboundedPreceding, 0)
    alone = F.count("*").over(Window.partitionBy("account_id", "occurred_on")) == 1
    mine = ledger.where(carries).repartition(spread(accounts), "account_id")
    mine = mine.withColumn("running_balance", F.when(alone, 100 + F.sum("amount").over(so_far)).cast("decimal(18,2)"))
    return mine.unionByName(ledger.where(~carries).withColumn("running_balance", F.lit(None).cast("decimal(18,2)")))


def reconciled(spark: SparkSession, d: str, closings: DataFrame | None = None, ledger: DataFrame | None = None) -> DataFrame:
    rows = L.orders_ledger(spark, d, describe=False, household=False) if ledger is None else ledger
    ledger = with_running_balances(rows, L.accounts(spark, d))
    return balances.reconcile(
        ledger, L.accounts(spark, d), L.opening_anchors(spark, d), L.checkpoints(spark, d) if closings is None else closings,
        balances.empty_periods(spark), start=START, end=END, as_of=L.AS_OF, seed_day=L.OPENING_DAY,
    )


@query("bal5_reconcile_periods", "ol ac an cp", RECON_SQL + """
SELECT account_id, s AS period_start, e AS period_end, CAST(opening AS DOUBLE) AS statement_opening, CAST(closing AS DOUBLE) AS statement_closing,
  src AS closing_source,
  CAST(computed AS DOUBLE) AS computed_closing,
  CAST(CASE WHEN fixed IS NOT NULL AND abs(closing - computed) <= 0.01 THEN 0 ELSE closing - computed END AS DOUBLE) AS variance
FROM rc
""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    out = reconciled(spark, d).select(
        *balances.PERIOD_KEY, "statement_opening", "statement_closing", "closing_source", "computed_closing", "variance"
    )
    return doubles(out, "statement_opening", "statement_closing", "computed_closing", "variance")


@query("bal6_checkpoint_periods", "ol ac an cp", RECON_SQL + """
SELECT account_id, s AS period_start, e AS period_end, role, CAST(opening AS DOUBLE) AS statement_opening, CAST(net AS DOUBLE) AS net,
  CAST(computed AS DOUBLE) AS computed_closing, CASE WHEN role = 'verify' THEN
    coalesce((SELECT max(occurred_on) FROM ol WHERE ol.account_id = rc.account_id) > e, false) OR DATE '2001-08-01' - e > 35 END AS checkpoint_stale
FROM rc WHERE role <> 'plain'
""")
def checkpoint_periods(spark: SparkSession, d: str) -> DataFrame:
    out = reconciled(spark, d).where("role <> 'plain'")
    net = F.col("computed_inflows") + F.col("computed_transfers_in") - F.col("computed_outflows") - F.col("computed_transfers_out")
    out = out.withColumn("net", net).select(
        *balances.PERIOD_KEY, "role", "statement_opening", "net", "computed_closing", "checkpoint_stale"
    )
    return doubles(out, "statement_opening", "net", "computed_closing")


@query("bal7_checkpoint_staleness", "ol ac cp", """
WITH n AS (SELECT account_id, max(as_of) AS day FROM cp GROUP BY 1), l AS (SELECT account_id, max(occurred_on) AS last_on FROM ol GROUP BY 1)
SELECT n.account_id, day AS checkpoint_day, last_on AS newest_row, CAST(DATE '1999-03-01' - day AS INTEGER) AS age_days,
  coalesce(last_on > day, false) OR DATE '1999-03-01' - day > 35 AS stale
FROM n LEFT JOIN l ON l.account_id = n.account_id
""")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False, household=False)
    return balances.checkpoint_staleness(ledger, L.checkpoints(spark, d), "1999-03-01")


@query("bal8_month_list", "ac", """
SELECT account_id, CAST(m AS DATE) AS period_start, least(last_day(CAST(m AS DATE)), DATE '1999-04-17') AS period_end
FROM ac, generate_series(TIMESTAMP '1998-11-01', TIMESTAMP '1999-04-01', INTERVAL 1 MONTH) g(m)
""")
def month_list(spark: SparkSession, d: str) -> DataFrame:
    return balances.months_in_range(L.accounts(spark, d).select("account_id"), "1998-11-20", "1999-04-17")


@query("bal9_upsert_checkpoint", "ol ac an cp", RECON_SQL.replace("RECURSIVE rb AS", """RECURSIVE en AS (
  SELECT account_id, DATE '1997-06-20' AS as_of, CAST(k * 10 AS DECIMAL(18,2)) AS balance FROM ac WHERE k % 5 = 0 AND account_type <> 'credit_card'),
cp2 AS (SELECT account_id, as_of, balance FROM cp UNION ALL SELECT * FROM en), rb AS""").replace("FROM cp JOIN", "FROM cp2 cp JOIN").replace(
    "FROM cp WHERE", "FROM cp2 cp WHERE") + """,
nw AS (SELECT *, lead(opening) OVER (PARTITION BY account_id ORDER BY s) AS nxt FROM rc)
SELECT en.account_id, as_of AS period_end, s AS period_start, CAST(closing AS DOUBLE) AS statement_closing, CAST(computed AS DOUBLE) AS computed_closing,
  CAST(CASE WHEN abs(closing - computed) <= 0.01 THEN 0 ELSE closing - computed END AS DOUBLE) AS variance, CAST(nxt AS DOUBLE) AS next_opening
FROM en LEFT JOIN nw ON nw.account_id = en.account_id AND nw.e = as_of
""")
def upsert_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """A new checkpoint for every fifth account; those on cards are refused, those of accounts with running balances open no period."""
    accounts = L.accounts(spark, d)
    k = F.substring("account_id", 6, L.ID_WIDTH).cast("bigint")
    entry = accounts.where(k % 5 == 0).select(
        "account_id", F.lit("1997-06-20").cast("date").alias("as_of"), (k * 10).cast("decimal(18,2)").alias("balance")
    )
    closings = balances.upsert_checkpoint(L.checkpoints(spark, d), entry, accounts)
    cash = entry.join(accounts.where("account_type <> 'credit_card'").select("account_id"), "account_id")
    out = balances.checkpoint_result(reconciled(spark, d, closings), cash).drop("checkpoint_stale")
    return doubles(out, "statement_closing", "computed_closing", "variance", "next_opening")


@query("bal10_checkpoint_deltas", "ol ac an cp", RECON_SQL + """,
ck AS (
  SELECT cp.account_id, as_of, balance, row_number() OVER w AS position, lag(balance) OVER w AS pb, lag(as_of) OVER w AS pd, CAST(date_trunc('month', as_of) AS DATE) AS ms
  FROM cp WINDOW w AS (PARTITION BY cp.account_id, date_trunc('month', as_of) ORDER BY as_of)),
dl AS (
  SELECT ck.account_id, as_of, balance, position, balance - coalesce(pb, rc.opening) - coalesce((SELECT sum(effect) FROM ol
    WHERE ol.account_id = ck.account_id AND occurred_on <= as_of AND occurred_on > coalesce(pd, CAST(ms - 1 AS DATE))), 0) AS delta
  FROM ck JOIN rc ON rc.account_id = ck.account_id AND rc.s = ms)
SELECT account_id, as_of, CAST(balance AS DOUBLE) AS balance, CAST(position AS BIGINT) AS position,
  CAST(CASE WHEN abs(delta) <= 0.01 THEN 0 ELSE delta END AS DOUBLE) AS delta FROM dl
""")
def checkpoint_deltas(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.orders_ledger(spark, d, describe=False, household=False)
    out = balances.checkpoint_deltas(ledger, L.checkpoints(spark, d), reconciled(spark, d))
    return doubles(out, "balance", "delta").withColumn("position", F.col("position").cast("bigint"))


@query("bal11_save_explanations", "ol ac an cp", RECON_SQL + """
SELECT account_id, s AS period_start, e AS period_end, CASE WHEN variance THEN 'known gap' ELSE note END AS variance_explanation
FROM (SELECT *, role = 'plain' AND month(s) = 4 AS variance, CASE WHEN role = 'verify' THEN 'checkpoint' ELSE '' END AS note FROM rc) x
""")
def save_explanations(spark: SparkSession, d: str) -> DataFrame:
    periods = reconciled(spark, d)
    notes = periods.where((F.col("role") == "plain") & (F.month("period_start") == 4)).select(
        *balances.PERIOD_KEY, F.lit("known gap").alias("explanation")
    )
    shown = F.when(F.col("variance_explanation").startswith(balances.CHECKPOINT_NOTE), "checkpoint").otherwise(F.col("variance_explanation"))
    return balances.save_explanations(periods, notes).select(*balances.PERIOD_KEY, shown.alias("variance_explanation"))


@query("bal12_goal_progress", "ol ac an cp ga hp", RECON_SQL + """,
sv AS (
  SELECT household_id, max_by(coalesce(closing, computed), (e, rc.account_id)) AS c FROM rc JOIN ac ON ac.account_id = rc.account_id
  WHERE rc.account_type = 'savings' AND coalesce(closing, computed) IS NOT NULL GROUP BY 1)
SELECT hp.household_id, CAST(coalesce(c, 1) AS DOUBLE) AS current_amount, least(CAST(coalesce(c, 1) AS DOUBLE) / CAST(goal_target AS DOUBLE), 1.0) AS progress,
  CAST(coalesce(c, 1) AS DOUBLE) / CAST(goal_target AS DOUBLE) >= 1 AS complete
FROM hp LEFT JOIN sv ON sv.household_id = hp.household_id
""")
def goal_progress(spark: SparkSession, d: str) -> DataFrame:
    out = balances.goal_progress(reconciled(spark, d), L.accounts(spark, d), _goals(spark, d))
    return doubles(out.select("household_id", "current_amount", "progress", "complete"), "current_amount")


@query("bal12_trajectory", "ol ac an cp", RECON_SQL + """
SELECT account_id, e AS day, CAST(coalesce(closing, computed) AS DOUBLE) AS balance FROM rc
WHERE account_type = 'savings' AND coalesce(closing, computed) IS NOT NULL
""")
def trajectory(spark: SparkSession, d: str) -> DataFrame:
    return doubles(balances.trajectory(reconciled(spark, d), L.accounts(spark, d)), "balance")


@query("win7_latest_and_history", "ol ac an cp", RECON_SQL + """
SELECT account_id, s AS period_start, CAST(row_number() OVER (PARTITION BY account_id ORDER BY e DESC, s DESC) AS BIGINT) AS recency FROM rc
""")
def latest_and_history(spark: SparkSession, d: str) -> DataFrame:
    out = balances.latest_and_history(reconciled(spark, d))
    return out.select("account_id", "period_start", F.col("recency").cast("bigint").alias("recency"))


@query("expr15_variance_badge", "ol ac an cp", RECON_SQL + """
SELECT account_id, s AS period_start, CASE WHEN closing - computed IS NULL THEN 'unknown' WHEN abs(closing - computed) < 1 THEN 'green'
  WHEN abs(closing - computed) <= 10 THEN 'yellow' ELSE 'red' END AS badge FROM rc
""")
def variance_badge(spark: SparkSession, d: str) -> DataFrame:
    return reconciled(spark, d).select("account_id", "period_start", S.variance_badge("variance").alias("badge"))


@query("join17_prior_closing", "ol ac an cp", RECON_SQL + """,
bf AS (SELECT account_id, max_by(coalesce(closing, computed), (e, s)) FILTER (e < DATE '1998-07-01') AS prior FROM rc GROUP BY 1)
SELECT account_id, CAST(prior AS DOUBLE) AS prior_closing FROM bf
""")
def prior_closing(spark: SparkSession, d: str) -> DataFrame:
    return doubles(balances.prior_closing(reconciled(spark, d), "1998-07-01"), "prior_closing")


@query("join15_payment_tier", "ol ln", """
SELECT id, loan, CAST(coalesce((SELECT max_by(scheduled_payment, effective_from) FROM lt WHERE lt.loan = ln.loan AND effective_from <= occurred_on),
  (SELECT min_by(scheduled_payment, effective_from) FROM lt WHERE lt.loan = ln.loan)) AS DOUBLE) AS scheduled_payment
FROM ol JOIN ln ON ln.household_id = ol.household_id
""")
def payment_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = L.orders_ledger(spark, d, describe=False).join(L.loans(spark, d).select("household_id", "loan"), "household_id")
    out = loans.with_tier(rows.select("id", "loan", "occurred_on"), L.loan_tiers(spark, d), "occurred_on")
    return doubles(out.select("id", "loan", "scheduled_payment"), "scheduled_payment")


@query("join16_balance_anchor", "ol ln", """
WITH m AS (SELECT DISTINCT ln.loan, CAST(date_trunc('month', occurred_on) AS DATE) AS month_start FROM ol JOIN ln ON ln.household_id = ol.household_id)
SELECT m.loan, month_start, coalesce((SELECT max(anchor_month) FROM la WHERE la.loan = m.loan AND anchor_month <= month_start),
  (SELECT min(anchor_month) FROM la WHERE la.loan = m.loan)) AS anchor_month FROM m
""")
def balance_anchor(spark: SparkSession, d: str) -> DataFrame:
    months = (
        L.orders_ledger(spark, d, describe=False)
        .join(L.loans(spark, d).select("household_id", "loan"), "household_id")
        .select("loan", F.trunc("occurred_on", "month").alias("month_start"))
        .distinct()
    )
    return loans.with_anchor(months, L.loan_anchors(spark, d), "month_start").select("loan", "month_start", "anchor_month")


@query("expr13_month_functions", "ol", """
SELECT id, strftime(occurred_on, '%Y-%m') AS label, CAST(date_trunc('month', occurred_on) AS DATE) AS month_start,
  CAST(date_trunc('month', occurred_on) + INTERVAL 1 MONTH AS DATE) AS next_start, last_day(occurred_on) AS month_end,
  CAST(year(occurred_on) * 12 + month(occurred_on) - 1 AS INTEGER) AS month_index
FROM ol
""")
def month_functions(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("occurred_on")
    return L.orders_ledger(spark, d, describe=False, household=False).select(
        "id", S.month_label(day).alias("label"), S.month_start(day).alias("month_start"), S.next_month_start(day).alias("next_start"),
        F.last_day(day).alias("month_end"), S.month_index(day).alias("month_index"),
    )



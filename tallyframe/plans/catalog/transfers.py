"""Transfer pairing, balanced clusters and suspected legs over the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import transfers
from tallyframe.plans.registry import query
from tallyframe.sources import sample_ledger as L

# The pairing rules written row by row: every candidate pair is listed, as the small test data allows.
PAIR_SQL = """
cd AS (
  SELECT id, account_id, occurred_on AS d, CAST(abs(amount) * 100 AS BIGINT) AS cents, sign(amount) AS sg
  FROM el WHERE direction = 'transfer' AND primary_category = 'transfer'),
near AS (
  SELECT a.id, b.id AS pid, abs(a.d - b.d) AS gap FROM cd a JOIN cd b ON a.cents = b.cents AND a.account_id <> b.account_id
    AND a.sg * b.sg < 0 AND abs(a.d - b.d) <= 5),
best AS (
  SELECT id, list(pid ORDER BY pid) AS partners FROM near n
  WHERE gap = (SELECT min(gap) FROM near m WHERE m.id = n.id) GROUP BY id),
same_acct AS (
  SELECT a.id, count(*) AS hits FROM cd a JOIN cd b ON a.cents = b.cents AND a.account_id = b.account_id AND a.id <> b.id
    AND abs(a.d - b.d) <= 5 GROUP BY 1),
bucket AS (SELECT cents, count(*) AS n FROM cd GROUP BY 1),
mutual AS (
  SELECT a.id, a.partners[1] AS pid FROM best a JOIN best b ON b.id = a.partners[1]
  WHERE len(a.partners) = 1 AND len(b.partners) = 1 AND b.partners[1] = a.id),
mpair AS (
  SELECT m.id AS left_id, m.pid AS right_id FROM mutual m JOIN cd x ON x.id = m.id JOIN cd y ON y.id = m.pid
  WHERE (x.d, x.id) < (y.d, y.id)),
amb AS (SELECT b.id, account_id, partners FROM best b JOIN cd ON cd.id = b.id WHERE len(partners) > 1),
grp AS (SELECT account_id, partners, list(id ORDER BY id) AS members FROM amb GROUP BY 1, 2),
gp AS (
  SELECT g.account_id AS acct_a, h.account_id AS acct_b, g.members AS ma, h.members AS mb
  FROM grp g JOIN grp h ON g.partners = h.members AND h.partners = g.members AND len(g.members) = len(h.members)
    AND g.account_id < h.account_id),
ok AS (
  SELECT * FROM gp WHERE NOT EXISTS (
    SELECT 1 FROM amb r WHERE NOT list_contains(ma, r.id) AND NOT list_contains(mb, r.id)
      AND (list_has_any(r.partners, ma) OR list_has_any(r.partners, mb)))),
gpair AS (SELECT unnest(ma) AS left_id, unnest(mb) AS right_id, acct_a, acct_b FROM ok),
pairs AS (
  SELECT left_id, right_id, 'mutual' AS kind FROM mpair UNION ALL SELECT left_id, right_id, 'group' FROM gpair)"""

KEY_SQL = "substr(sha256(least(left_id, right_id) || '|' || greatest(left_id, right_id)), 1, 32)"


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = transfers.candidates(L.events_ledger(spark, d))
    return rows, transfers.settled_cells(rows)


@query("join8_transfer_candidates", "el", f"""
WITH {PAIR_SQL}
SELECT cd.id, CAST(coalesce(len(partners), 0) AS BIGINT) AS partners, coalesce(hits, 0) AS same_account_hits,
  CASE WHEN len(partners) = 1 THEN partners[1] END AS partner_id
FROM cd LEFT JOIN best ON best.id = cd.id LEFT JOIN same_acct ON same_acct.id = cd.id
""")
def transfer_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows, cells = _parts(spark, d)
    view = cells.select(*transfers.CELL, "partners", "same_account_hits", "partner_id")
    return rows.join(view, list(transfers.CELL)).select("id", "partners", "same_account_hits", "partner_id")


@query("trf1_mutual_pairs", "el", f"WITH {PAIR_SQL} SELECT left_id, right_id FROM mpair")
def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    return transfers.mutual_pairs(_parts(spark, d)[1]).select("left_id", "right_id")


@query("trf2_unpaired_reasons", "el", f"""
WITH {PAIR_SQL},
settled AS (SELECT id, pid, least((SELECT (d, id) FROM cd WHERE cd.id = m.id), (SELECT (d, id) FROM cd WHERE cd.id = m.pid)) AS settled_at FROM mutual m),
done AS (SELECT left_id AS id FROM pairs UNION SELECT right_id FROM pairs),
st AS (
  SELECT cd.*, coalesce(len(partners), 0) AS np, partners, coalesce(hits, 0) AS hits, n,
    CASE WHEN done.id IS NOT NULL THEN 'paired'
      WHEN len(partners) > 1 OR (partners IS NULL AND coalesce(hits, 0) > 0) THEN 'ambiguous' ELSE 'unpaired' END AS status
  FROM cd LEFT JOIN best ON best.id = cd.id LEFT JOIN same_acct ON same_acct.id = cd.id LEFT JOIN done ON done.id = cd.id
    JOIN bucket ON bucket.cents = cd.cents)
SELECT st.id, status, CAST(CASE WHEN np > 0 THEN np ELSE hits END AS BIGINT) AS candidate_count,
  CASE WHEN status <> 'unpaired' THEN NULL WHEN np = 0 AND n <= 1 THEN 'no candidate within the date tolerance'
    WHEN np = 0 THEN 'no candidate on another account within the date tolerance'
    WHEN settled_at < (d, st.id) THEN 'preferred partner already paired with a closer match'
    ELSE 'partner had a closer or ambiguous match elsewhere' END AS reason
FROM st LEFT JOIN settled ON settled.id = st.partners[1] AND np = 1
""")
def unpaired_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows, cells = _parts(spark, d)
    out = transfers.candidate_status(rows, cells, transfers.pairs_of(rows, cells))
    return out.select("id", "status", "candidate_count", "reason")


@query("trf3_group_pairs", "el", f"WITH {PAIR_SQL} SELECT left_id, right_id, acct_a AS left_account, acct_b AS right_account FROM gpair")
def group_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows, cells = _parts(spark, d)
    pairs = transfers.group_pairs(rows, transfers.balanced_groups(cells))
    return pairs.select("left_id", "right_id", "left_account", "right_account")


# Re-arming needs inbound rows that were turned into inflows: every 'signup' event of the second pool plays one.
REARM_SQL = """
arm AS (
  SELECT id, account_id, occurred_on, amount,
    CASE WHEN description_raw = 'CARD SIGNUP' AND amount > 0 THEN 'inflow' ELSE direction END AS direction,
    CASE WHEN description_raw = 'CARD SIGNUP' AND amount > 0 THEN 'transfer' ELSE primary_category END AS primary_category, description_raw
  FROM el)"""


def rearm_ledger(spark: SparkSession, d: str) -> DataFrame:
    inbound = (F.col("description_raw") == "CARD SIGNUP") & (F.col("amount") > 0)
    return L.events_ledger(spark, d).withColumn("primary_category", F.when(inbound, "transfer").otherwise(F.col("primary_category")))


def rearm_domain():
    return transfers.inbound_domain(("pool-1",), ("card signup",))


RE_PAIR_SQL = REARM_SQL + "," + PAIR_SQL.replace(
    "FROM el WHERE direction = 'transfer' AND primary_category = 'transfer'",
    "FROM arm WHERE primary_category = 'transfer' AND (direction = 'transfer' OR (account_id = 'pool-1' AND description_raw = 'CARD SIGNUP'))",
)


@query("trf4_rearm_reclassify", "el", f"""
WITH {RE_PAIR_SQL},
done AS (SELECT left_id AS id FROM pairs UNION SELECT right_id FROM pairs),
own AS (
  SELECT arm.id, arm.direction, arm.direction = 'inflow' AS rearmed,
    done.id IS NULL AND NOT coalesce(len(partners) > 1 OR (partners IS NULL AND coalesce(hits, 0) > 0), false) AS fallen, done.id IS NOT NULL AS paired
  FROM arm JOIN cd ON cd.id = arm.id LEFT JOIN done ON done.id = arm.id LEFT JOIN best ON best.id = arm.id LEFT JOIN same_acct ON same_acct.id = arm.id
  WHERE arm.account_id = 'pool-1' AND description_raw = 'CARD SIGNUP')
SELECT id, rearmed, fallen AS reclassified, CASE WHEN fallen THEN 'inflow' ELSE 'transfer' END AS direction, paired FROM own
""")
def rearm(spark: SparkSession, d: str) -> DataFrame:
    applied = transfers.apply_pairing(rearm_ledger(spark, d), domain=rearm_domain())
    return applied.where("rearmed OR reclassified").select(
        "id", "rearmed", "reclassified", "direction", F.col("transfer_group_key").isNotNull().alias("paired")
    )


@query("trf5_pairing_run", "el", f"""
WITH {RE_PAIR_SQL}
SELECT arm.id, {KEY_SQL} AS transfer_group_key, CASE WHEN cd.id IS NULL OR NOT (arm.account_id = 'pool-1' AND description_raw = 'CARD SIGNUP') THEN arm.direction
  WHEN left_id IS NULL AND NOT coalesce(len(partners) > 1 OR (partners IS NULL AND coalesce(hits, 0) > 0), false) THEN 'inflow' ELSE 'transfer' END AS direction
FROM arm LEFT JOIN cd ON cd.id = arm.id LEFT JOIN pairs ON arm.id IN (left_id, right_id) LEFT JOIN best ON best.id = arm.id LEFT JOIN same_acct ON same_acct.id = arm.id
""")
def pairing_run(spark: SparkSession, d: str) -> DataFrame:
    applied = transfers.apply_pairing(rearm_ledger(spark, d), domain=rearm_domain())
    return applied.select("id", "transfer_group_key", "direction")


@query("trf5_pairing_counts", "el", f"""
WITH {RE_PAIR_SQL},
done AS (SELECT left_id AS id FROM pairs UNION SELECT right_id FROM pairs),
st AS (
  SELECT arm.direction = 'inflow' AS rearmed, done.id IS NOT NULL AS paired,
    len(partners) > 1 OR (partners IS NULL AND coalesce(hits, 0) > 0) AS amb, account_id = 'pool-1' AND description_raw = 'CARD SIGNUP' AS owned
  FROM arm JOIN cd USING (id) LEFT JOIN done USING (id) LEFT JOIN best USING (id) LEFT JOIN same_acct USING (id))
SELECT 'hh-00' AS household_id, (SELECT count(*) FROM pairs) AS pairs_created, count(*) AS candidates_examined, CAST(0 AS BIGINT) AS already_paired,
  count(*) FILTER (NOT paired AND NOT coalesce(amb, false) AND NOT owned) AS unpaired, count(*) FILTER (NOT paired AND amb) AS ambiguous,
  count(*) FILTER (NOT paired AND NOT coalesce(amb, false) AND owned) AS inbound_reclassified, count(*) FILTER (rearmed) AS inbound_rearmed,
  count(*) FILTER (rearmed AND (paired OR amb)) AS inbound_rearmed_paired
FROM st
""".replace("arm JOIN cd USING (id)", "(SELECT arm.* FROM arm) arm JOIN (SELECT id FROM cd) cd USING (id)"))
def pairing_counts(spark: SparkSession, d: str) -> DataFrame:
    return transfers.run_counts(transfers.apply_pairing(rearm_ledger(spark, d), domain=rearm_domain()))


@query("join9_suspected_untagged", "el", f"""
WITH {PAIR_SQL},
lg AS (
  SELECT CASE p.kind WHEN 'mutual' THEN 0 ELSE 1 END AS k, l.d AS ld, left_id, leg, CASE leg WHEN 0 THEN left_id ELSE right_id END AS leg_id,
    CASE leg WHEN 0 THEN l.d ELSE r.d END AS leg_day, l.cents, l.account_id AS a, r.account_id AS b
  FROM pairs p JOIN cd l ON l.id = left_id JOIN cd r ON r.id = right_id, (VALUES (0), (1)) v(leg)),
hit AS (
  SELECT el.id, leg_id, description_raw, row_number() OVER (PARTITION BY el.id ORDER BY k, ld, left_id, leg) AS rn
  FROM el JOIN lg ON lg.cents = CAST(abs(amount) * 100 AS BIGINT) AND abs(occurred_on - leg_day) <= 5 AND el.account_id NOT IN (a, b)
  WHERE direction <> 'transfer')
SELECT id, leg_id AS likely_partner_id, CASE WHEN regexp_matches(description_raw, '(?i)venmo\\s*payment') THEN 'strong' ELSE 'weak' END AS confidence
FROM hit WHERE rn = 1
""")
def suspected(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.events_ledger(spark, d)
    out = transfers.suspected_untagged(ledger, transfers.pair_transfers(ledger))
    return out.select("id", "likely_partner_id", "confidence")


CLUSTER_SQL = """
un AS (SELECT id, account_id, occurred_on AS d, CAST(abs(amount) * 100 AS BIGINT) AS cents, CAST(amount * 100 AS BIGINT) AS signed
  FROM el WHERE primary_category = 'transfer'),
br AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY cents ORDER BY d, id) > 5 THEN 1 ELSE 0 END AS b FROM un),
rn AS (SELECT *, sum(b) OVER (PARTITION BY cents ORDER BY d, id) AS run FROM br),
cl AS (SELECT cents, run, min(d) AS first_on, max(d) AS last_on, count(*) AS legs,
    count(*) >= 2 AND count(DISTINCT account_id) >= 2 AND sum(signed) = 0 AS balanced FROM rn GROUP BY 1, 2)"""


@query("win10_balanced_clusters", "el", f"WITH {CLUSTER_SQL} SELECT cents, first_on, last_on, legs, balanced FROM cl")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    out = transfers.unpaired_clusters(L.events_ledger(spark, d))
    return out.select("cents", "first_on", "last_on", F.col("legs").cast("bigint").alias("legs"), "balanced")

"""The numbered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import langid, lexicon, merkle, mixing, mtree, neardup, packing, repeats, sequences, syncmers, urls, warc, whitening
from tallyframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op3_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.round_trip(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents")).drop("spans")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op11_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon.round_trip(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_every())
    return merkle.verified(rows).drop("path", "claimed")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc, op2_syncmers, op3_sequences, op4_nearest, op5_packing, op6_urls, op7_near_duplicates, op8_mix, op9_language, op10_repeats,
        op11_lexicon, op12_merkle, op13_whitening,
    )
}
# Only what SQL can say: no tokenizer, learned model, hash of Spark's or byte-wise suffix sort.
ORACLES: dict[str, str] = {}

ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT *, sha1(t) || '0' AS h, min(page_id) OVER (PARTITION BY t) AS f FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(1 + (5 * i) // 4 AS INTEGER), 3) AS BIGINT) >> (7 - (5 * i) % 4)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM d
"""

ORACLES["op4_nearest"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

ORACLES["op7_near_duplicates"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS hop FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.hop),
m AS (SELECT id, min(hop) AS c FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON m.id = doc_id
"""

ORACLES["op8_mix"] = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c),
f AS (SELECT *, (total - before) * w >= cap * rest AS stops FROM o),
t AS (
  SELECT source, source_size, CASE WHEN stops THEN cap ELSE (total - coalesce(sum(cap) FILTER (stops) OVER (), 0)) * w / sum(w) FILTER (NOT stops) OVER () END AS target FROM f),
b AS (SELECT *, target - base * source_size AS need FROM (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS base FROM t)),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
v AS (
  SELECT z.source, size, need - CAST(coalesce(sum(size * n) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
    CAST(sum(CAST(size AS HUGEINT) * size * n) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS squares
  FROM z JOIN b ON b.source IS NOT DISTINCT FROM z.source),
h AS (
  SELECT source, max(size) AS top, arg_max(rest, size) AS rest, CASE WHEN arg_max(rest, size) > 0 THEN arg_max(rest, size) / arg_max(squares, size) ELSE 0 END AS rate
  FROM v WHERE rest * size < squares GROUP BY source),
x AS (
  SELECT doc_id, d.size, source_size, target, base, d.source AS src, coalesce(rest, 0) AS rest, d.size > coalesce(top, 0) AS sure, coalesce(rate, 0) * d.size AS p,
    (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || 'mix'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source LEFT JOIN h ON h.source IS NOT DISTINCT FROM d.source),
q AS (SELECT *, NOT sure AND p > 0 AS drawn, CASE WHEN NOT sure AND p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM x),
y AS (SELECT *, sum(size) OVER (PARTITION BY src, drawn ORDER BY odds / (1 + odds), CAST(doc_id AS VARCHAR)) AS upto FROM q)
SELECT doc_id, size, source_size, target, size * CAST(base + CASE WHEN sure OR (drawn AND upto - size / 2.0 <= rest) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM y
"""

ORACLES["op12_merkle"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, n_chars, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS f,
    [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] AS g,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 7 = 0 AS hit FROM documents),
l AS (
  SELECT doc_id, grp, sha256(array_to_string(list_transform(f, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '')) AS leaf,
    sha256(array_to_string(list_transform(CASE WHEN hit THEN g ELSE f END, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '')) AS claimed FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM l),
t AS (
  SELECT grp, 0 AS lvl, idx, n, leaf AS h FROM n
  UNION ALL SELECT grp, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY grp, lvl, idx // 2, n),
s AS (SELECT grp, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos AS idx, n, h FROM s
  UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 2, n),
a AS (SELECT grp, lvl, idx, n, h, 0 AS tier FROM t WHERE n > 1 UNION ALL SELECT '', lvl, idx, n, h, 1 FROM u WHERE n > 1),
p AS (
  SELECT doc_id, n.grp, n.idx, n.leaf, 0 AS tier, x.lvl, n.idx // CAST(2 ** x.lvl AS BIGINT) AS at FROM n JOIN (SELECT DISTINCT grp, lvl FROM a WHERE tier = 0) x ON x.grp = n.grp
  UNION ALL SELECT doc_id, n.grp, n.idx, n.leaf, 1, x.lvl, s.pos // CAST(2 ** x.lvl AS BIGINT) FROM n JOIN s ON s.grp = n.grp CROSS JOIN (SELECT DISTINCT lvl FROM a WHERE tier = 1) x),
q AS (
  SELECT p.grp, p.idx, list(struct_pack(b := CASE WHEN p.at % 2 = 1 THEN coalesce(a.h, '') ELSE '' END, e := CASE WHEN p.at % 2 = 0 THEN coalesce(a.h, '') ELSE '' END) ORDER BY p.tier, p.lvl) AS path
  FROM p LEFT JOIN a ON a.tier = p.tier AND a.lvl = p.lvl AND a.idx = xor(p.at, 1) AND (p.tier = 1 OR a.grp = p.grp) GROUP BY p.grp, p.idx),
r AS (
  SELECT n.doc_id, n.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(q.path, []) AS path, n.claimed
  FROM n JOIN s ON s.grp = n.grp LEFT JOIN q ON q.grp = n.grp AND q.idx = n.idx),
f AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.b || x.e), '')) AS proof_sha256,
    list_reduce(list_concat([struct_pack(b := claimed, e := '')], path), lambda c, x: struct_pack(b := sha256(x.b || c.b || x.e), e := '')).b AS folded_root FROM r)
SELECT *, folded_root = root AS verified FROM f
"""

"""Document fingerprints from closed syncmers, with Spark's own functions only.

The letters are words. Of every run of ``K`` words the ``S``-word runs inside it are hashed; the run
is an anchor if the smallest of these stands first or last in it. Whether a run is an anchor depends
on its own words alone, so an unchanged passage keeps its anchors wherever it moves, and anchors of
two texts can be matched by content and place. A fingerprint is the text's anchors in order, eight
hex digits each. The likeness of two fingerprints is the Jaccard similarity of their distinct anchors.

Every document is compared with the one of the next smaller id. Documents are dealt into ranges of
ids; a range needs, beside its own rows, only the first row of the range below, which is read again
and added as a guest. So one shuffle moves each text once, and no order over all rows is taken.

Defined results: null text is empty; a text without words has an empty fingerprint, and two empty
fingerprints have likeness 1, an empty and another one 0. A text with no anchor of its own, such as
one of fewer than ``K`` words, has its whole word sequence as its anchor. Null ids come after all
others. Rows of equal id are ordered by a hash of their text. A table of one row is its own next
document; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import GAP, parts_for

K, S = 8, 3


def _with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the 32-bit hashes of the anchors of column ``text`` in order, as the fingerprint shows them."""
    words, hashes, inner, found = (f"_{x}_{name}" for x in ("words", "hashes", "inner", "found"))
    n = F.size(hashes)
    span = K - S + 1

    def chosen(i: Column) -> Column:
        first, last = F.get(inner, i), F.get(inner, i + (span - 1))
        least = F.least(*[F.get(inner, i + j) for j in range(span)])
        return (i <= n - K) & ((least == first) | (least == last))

    half = lambda x: F.shiftrightunsigned(x, 32)
    anchor = lambda x, i: F.when(chosen(i), half(F.xxhash64(*[F.get(hashes, i + j) for j in range(K)])))
    whole = F.when(F.size(hashes) > 0, F.array(half(F.xxhash64(hashes)))).otherwise(F.array().cast("array<bigint>"))
    return (
        df.withColumn(words, F.filter(F.split(text, GAP), lambda x: x != ""))
        .withColumn(hashes, F.transform(words, lambda x: F.xxhash64(x)))
        .withColumn(inner, F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, S)])))
        .withColumn(found, F.array_compact(F.transform(inner, anchor)))
        .withColumn(name, F.when(F.size(found) > 0, F.col(found)).otherwise(whole))
        .drop(words, hashes, inner, found)
    )


def _shown(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    shared, na, nb = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when(na + nb == 0, 1.0).otherwise(shared / (na + nb - shared))


def _range_of(points: list[int]) -> Column:
    """How many of the sorted ``points`` are not above ``doc_id``; whole strides first, then inside one."""
    if not points:
        return F.lit(0)
    every = F.lit(points).cast("array<bigint>")
    stride = max(1, int(len(points) ** 0.5))
    whole = F.size(F.filter(F.lit(points[stride - 1 :: stride]).cast("array<bigint>"), lambda p: p <= F.col("doc_id"))) * stride
    return whole + F.size(F.filter(F.slice(every, whole + 1, F.lit(stride)), lambda p: p <= F.col("doc_id")))


def _dealt(docs: DataFrame) -> DataFrame:
    """``bucket, guest, doc_id, tie, text``: ranges of ids, each with the first row of the range below it as a guest."""
    n = parts_for(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    points = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("p")).first()["p"] if n > 1 else None
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(sorted(set(points or [])))).cast("int"))
    own = rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "tie", "text")
    # one row per range: its first row goes to the range above, that of the highest to the lowest
    in_order = Window.orderBy("bucket")
    tops = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("top"))
    tops = tops.select(
        F.coalesce(F.lead("bucket").over(in_order), F.min("bucket").over(in_order)).alias("above"), F.col("top.doc_id").alias("top_id"), F.col("top.tie").alias("top_tie")
    )
    # at most as many rows as ranges, so they may be broadcast
    first = rows.join(F.broadcast(tops), (F.col("tie") == F.col("top_tie")) & F.col("doc_id").eqNullSafe(F.col("top_id")))
    guests = first.dropDuplicates(["doc_id", "tie"])
    return own.unionByName(guests.select(F.col("above").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "tie", "text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, text, anchors, next`` of every row; ``next`` holds the text and anchors of the document after it."""
    dealt = _dealt(docs)
    placed = _with_anchors(dealt.repartition(parts_for(docs.sparkSession), "bucket"), "text", "anchors")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("tie"))
    return placed.withColumn("next", F.lead(F.struct("text", "anchors")).over(order)).where("not guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors`` of every row."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = _with_anchors(neighbours(docs).withColumn("edited", edited).withColumn("next_anchors", F.col("next.anchors")).drop("next"), "edited", "edited_anchors")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _shown("anchors").alias("fingerprint"),
        _shown("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
        F.size("anchors").alias("n_anchors"),
    )

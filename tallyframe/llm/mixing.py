"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document first gets the whole copies that every document of
its source is sure of. The rest of the target is a sample of a fixed number of words in which
documents have unequal inclusion probabilities, proportional to their size, so that the words taken
vary little: those whose probability would reach 1 are taken for certain and the rest share what is
left. Each other document draws a uniform number from its id and is ranked by its random odds over
the odds of its own probability; documents are taken in that order until the words are reached.

Only one row per source and rank bin is ever ordered as a whole. Ranks fall into bins, the words of
the bins are summed, and documents are ordered only in the one bin of a source in which its sample
ends, one row for all that agree in rank, id and size. That gives a cut per source, and a document
compares itself with the cut, so the texts are never shuffled. Certainties come from one row per
source and different size. Targets are found in one task over one row per source.

Defined results: null or empty text has size 0 and is never counted; a null source is a source of
its own, ordered last; a null ``doc_id`` draws like the id ``null``; rows of one id draw one number,
and where the sample ends among rows of equal id and size, as many of them are taken as it needs,
whichever they are; a source without words has target 0; an empty table gives no rows. Columns
beside ``doc_id``, ``text`` and ``source`` are kept by :func:`mixed` and ignored by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD, settle
from tallyframe.operators.ranges import number_in_group

BINS = 4096


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _uniform(seed: str) -> Column:
    """In (0, 1), from the first 48 bits of a digest of the id."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _size() -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", _size().alias("size"))


def targets(measured: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: ``k``, ``source_size``, ``target``, ``base`` copies and ``need`` words of the sample.

    Weights go round the sources in code-point order. A target stops at ``most`` times its source's
    size. Sources in order of size over weight: those that stop come first, and a source stops when
    the level reached with all before it stopped would carry it over.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy(F.col("cap") / F.col("w"), "k")
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    own = (
        measured.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .select(_key().alias("k"), "source_size", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).alias("w"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stops", (F.col("total") - F.col("before")) * F.col("w") >= F.col("cap") * F.col("rest"))
        .withColumn("stopped", F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("w"))).over(everything))
    )
    target = F.when(F.col("stops"), F.col("cap")).otherwise((F.col("total") - F.col("stopped")) * F.col("w") / F.col("open"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return own.select("k", "source_size", target.alias("target")).select(
        "k",
        "source_size",
        "target",
        F.floor(ratio).alias("base"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("need"),
    )


def _odds(measured: DataFrame, own: DataFrame) -> DataFrame:
    """Beside each source: ``limit``, above which documents are certain, the ``rate`` of others and their ``left`` words.

    With the sizes above ``limit`` taken whole, a document of size s is included with probability
    ``rate * s``; ``limit`` is the largest size at which that stays below 1.
    """
    above = Window.partitionBy("k").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("k").orderBy(F.desc("size")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    square = F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)") * F.col("n")
    found = (
        measured.where("size > 0").groupBy(_key().alias("k"), "size").agg(F.count(F.lit(1)).alias("n"))
        .join(own.select("k", "need"), "k")
        .withColumn("left", F.col("need") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(above), F.lit(0)).cast("double"))
        .withColumn("squares", F.sum(square.cast("decimal(28,0)")).over(below).cast("double"))
        .where(F.col("left") * F.col("size") < F.col("squares"))
        .groupBy("k")
        .agg(F.max(F.struct("size", "left", "squares")).alias("first"))
    )
    rate = F.when(F.col("first.left") > 0, F.col("first.left") / F.col("first.squares")).otherwise(0.0)
    named = found.select("k", F.col("first.size").alias("limit"), F.col("first.left").alias("left"), rate.alias("rate"))
    # without such a size the sample needs all words
    return own.join(named, "k", "left").fillna({"limit": 0, "left": 0.0, "rate": 0.0})


def _ranked(joined: DataFrame, seed: str) -> DataFrame:
    """Random odds over inclusion odds, mapped to [0, 1], and their bin."""
    u, share = _uniform(seed), F.col("rate") * F.col("size")
    ratio = (u / (1 - u)) / (share / (1 - share))
    return (
        joined.withColumn("sure", F.col("size") > F.col("limit"))
        .withColumn("rank", F.when(~F.col("sure") & (share > 0), ratio / (1 + ratio)).otherwise(F.lit(1.0)))
        .withColumn("bin", F.floor(F.col("rank") * BINS))
        .withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    )


def _cuts(ranked: DataFrame, own: DataFrame) -> DataFrame:
    """Per source the bin in which its sample ends, the last rank, id and size in it, and how many of those are taken."""
    sampled = ranked.where("size > 0 and not sure and rate > 0")
    order = Window.partitionBy("k").orderBy("bin")
    last_bins = (
        sampled.groupBy("k", "bin").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(order))
        .join(own.select("k", F.col("left").alias("room")), "k")
        .withColumn("before", F.col("upto") - F.col("words"))
        .where("before < room and upto >= room")
        .select("k", "bin", "before", "room")
    )
    inside = Window.partitionBy("k").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("room") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    ends = (
        sampled.join(last_bins, ["k", "bin"]).groupBy("k", "room", "before", "rank", "id", "size").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("take", F.least(F.col("n"), F.floor((room + F.col("size") / 2) / F.col("size"))))
        .where("take > 0")
        .groupBy("k")
        .agg(F.max(F.struct("rank", "id", "size", "take", "n")).alias("end"))
    )
    return last_bins.select("k", F.col("bin").alias("bin_cut")).join(ends, "k", "left").select(
        "k", "bin_cut", F.struct("end.rank", "end.id", "end.size").alias("cut"), F.col("end.take").alias("take"), F.col("end.n").alias("equal")
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The measured documents, and one row per source with its target, its odds and its cut."""
    measured = settle(_measured(docs), "mix-sizes")
    own = settle(_odds(measured, targets(measured, weights, share, most)), "mix-targets")
    ranked = _ranked(measured.join(own, _key() == F.col("k")), seed)
    return measured, settle(own.join(_cuts(ranked, own), "k", "left"), "mix-cuts")


def _with_copies(joined: DataFrame, own: DataFrame, seed: str) -> DataFrame:
    """``copies`` of every row: those it is sure of, and one more for certain documents and those before the cut."""
    ranked = _ranked(joined, seed)
    here = F.struct("rank", "id", "size")
    # rounding can leave a source a trace short of its sample: then all of it is taken
    ends = F.coalesce("bin_cut", F.when(F.col("left") > 0, BINS + 1).otherwise(-1))
    at_end = (F.col("bin") == ends) & F.coalesce(here == F.col("cut"), F.lit(False)) & ~F.col("sure")
    before = (F.col("bin") < ends) | ((F.col("bin") == ends) & F.coalesce(here < F.col("cut"), F.lit(False)))
    extra = F.col("sure") | before | at_end
    split = at_end & (F.col("take") < F.col("equal"))
    copies = (F.col("base") + extra.cast("long")).cast("int")
    if own.where("take < equal").isEmpty():
        return ranked.withColumn("copies", copies)
    numbered = number_in_group(
        ranked.where(split).withColumn("tie", F.monotonically_increasing_id()), ["k"], ["tie"], "place", cut=lambda df: settle(df, "mix-ties")
    )
    some = numbered.withColumn("copies", (F.col("base") + (F.col("place") <= F.col("take")).cast("long")).cast("int"))
    return ranked.where(~split).withColumn("copies", copies).unionByName(some.drop("tie", "place"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row of ``docs``."""
    measured, own = plan(docs, **how)
    return _with_copies(measured.join(own, _key() == F.col("k")), own, how.get("seed", "mix")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    _, own = plan(docs, **how)
    measured = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", _size().alias("size"))
    counted = _with_copies(measured.join(own, _key() == F.col("k")), own, how.get("seed", "mix"))
    return counted.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_doc.*")

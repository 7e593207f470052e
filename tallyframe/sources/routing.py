"""Routing files to tracked sources, source coverage, and layout dispatch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.sources import records
from tallyframe.sources.layouts import Layout, parse

# Score weights, threshold, kept matches.
TOKEN_WEIGHT = 0.65
NAME_WEIGHT = 0.35
EXTENSION_BONUS = 0.15
THRESHOLD = 0.35
TOP_FILES = 3

# File extensions a preferred format implies.
FORMAT_EXTENSIONS = {
    "csv": ("csv",),
    "pdf": ("pdf",),
    "screenshot": ("png", "jpg", "jpeg", "webp"),
    "worksheet": ("csv", "xlsx"),
    "invoice": ("pdf", "csv"),
}


def file_parts(path: Column | str) -> dict[str, Column]:
    """Stem, parent folder and lower-case extension of a path."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.substring_index(p, "/", -1)
    return {
        "stem": F.regexp_replace(name, r"\.[^.]*$", ""),
        "parent": F.coalesce(F.nullif(F.regexp_extract(p, r"([^/]+)/[^/]+$", 1), F.lit("")), F.lit("")),
        "extension": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)),
    }


def normal_text(value: Column) -> Column:
    return F.array_join(F.array_sort(S.tokens(value)), " ")


def expected_extensions(form: Column) -> Column:
    lowered = F.lower(F.coalesce(form, F.lit("")))
    parts = [
        F.when(lowered.contains(word), F.array(*[F.lit(e) for e in exts])).otherwise(F.array().cast("array<string>"))
        for word, exts in FORMAT_EXTENSIONS.items()
    ]
    return F.array_distinct(F.concat(*parts))


# Bigram likeness that a pair without a shared token needs beside the extension bonus: 2 * shared / (f + s).
LEAST_LIKENESS = (THRESHOLD - EXTENSION_BONUS) / NAME_WEIGHT

# A key of the index with more sources is cut into blocks of about so many, one with more files dealt over so many tasks' keys.
BLOCK_SOURCES = 64
CELL_FILES = 4096

# Names are lower-case letters, digits and blanks: a bigram is told by its place in a square of the signs from the blank on.
_SIGNS = 96

# A word is told by two of so many places; one whose places no source takes is a word of no source.
WORD_PLACES = 1 << 15

# What a file's scores depend on: words and bigrams that sources may hold, the number of all its bigrams, its extension.
SHAPE = ("_text", "_fg", "_n", "_fe")


def _gram_places(name: str) -> Column:
    """Bigrams of a name as numbers, which meet faster than texts."""
    return F.transform(S.bigrams(name), lambda g: ((F.ascii(g) - 32) * _SIGNS + F.ascii(F.substring(g, 2, 1)) - 32).cast("smallint"))


def _word_places(word: Column) -> tuple[Column, Column]:
    known = F.xxhash64(word)
    return F.pmod(known, F.lit(WORD_PLACES)).cast("int"), F.pmod(F.shiftright(known, 32), F.lit(WORD_PLACES)).cast("int")


def _unfolded(df: DataFrame, kept: Sequence[Column | str], values: Column, name: str) -> DataFrame:
    """A row for each of ``values``.

    For an inner ``explode`` Spark adds a filter on the size of its list and pushes it down to the first rows that tell it:
    lists would be worked out for each of a caller's rows before they are grouped, and a second time.
    """
    return df.select(*kept, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def _gram_counts(sources: DataFrame) -> DataFrame:
    """One row: how many sources hold the bigram of each place."""
    counted = _unfolded(sources, [], F.col("_grams"), "at").groupBy("at").agg(F.count("*").alias("n"))
    known = counted.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(_SIGNS * _SIGNS - 1))
    return known.select(F.transform(places, lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("smallint")), F.lit(0))).alias("_counts"))


def _marks(places: DataFrame, size: int) -> DataFrame:
    """One row: which of ``size`` places the rows of ``places(at)`` take, 64 to a number. It is copied along with rows, so it is short."""
    taken = places.groupBy(F.floor(F.col("at") / 64).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    slots = places.sparkSession.range(size // 64).join(F.broadcast(taken), F.col("id") == F.col("slot"), "left")
    in_order = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return slots.agg(F.transform(in_order, lambda x: x["bits"]).alias("marks"))


def _marked(marks: str, at: Column) -> Column:
    return F.getbit(F.get(marks, F.floor(at / 64).cast("int")), at % 64) == 1


def _word_marks(sources: DataFrame) -> DataFrame:
    words = _unfolded(sources, [], F.col("_words"), "word").distinct()
    return _marks(words.select(F.explode(F.array(*_word_places(F.col("word")))).alias("at")), WORD_PLACES)


def _gram_marks(sources: DataFrame) -> DataFrame:
    return _marks(_unfolded(sources, [], F.col("_grams"), "at").select(F.col("at").cast("int").alias("at")), _SIGNS * _SIGNS)


def _least_shared(bigrams: Column) -> Column:
    """How many bigrams a name of so many shares at least with one alike: with likeness at least t, n * t / (2 - t)."""
    return F.ceil(bigrams * (LEAST_LIKENESS / (2 - LEAST_LIKENESS)) - 1e-9)


def _in_order(grams: str, counts: Column) -> Column:
    """Bigrams in the common order: those that few sources hold first."""
    return F.transform(F.array_sort(F.transform(grams, lambda g: F.struct(F.get(counts, g.cast("int")).alias("n"), g.alias("gram")))), lambda x: x["gram"])


def _named(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the bigrams of a name; the name is a column, as an expression would be worked out for each of them."""
    return df.withColumn("_name", normal_text(text)).withColumn("_grams", _gram_places("_name"))


def _tracked(sources: DataFrame) -> DataFrame:
    """``source_id, position, _words, _grams, _exts`` of each source."""
    haystack = F.concat_ws(" ", "document", "category", "subject", "why_needed")
    return _named(sources, F.col("document")).select(
        "source_id", "position", S.tokens(haystack).alias("_words"), "_grams", expected_extensions(F.col("format")).alias("_exts")
    )


def _shaped(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """``files`` with their ``SHAPE``: files of one shape have the same score with every source.

    Words and bigrams that no source holds, such as numbers and dates, add nothing to a score, so they are left
    out of it; a word that only takes the places of others stays and counts as little.
    """
    parts = file_parts("path")
    f = files.withColumn("_words", S.tokens(F.concat_ws(" ", *parts.values())))
    f = _named(f, parts["stem"]).withColumns({"_gram_marks": _gram_marks(tracked).scalar(), "_word_marks": _word_marks(tracked).scalar()})
    words = F.filter("_words", lambda w: _marked("_word_marks", _word_places(w)[0]) & _marked("_word_marks", _word_places(w)[1]))
    grams = F.filter("_grams", lambda g: _marked("_gram_marks", g.cast("int")))
    known = sorted({e for exts in FORMAT_EXTENSIONS.values() for e in exts})
    # none of them is null, or joins by them would work them out once more to leave out nulls
    shape = {
        "_text": F.coalesce(F.array_join(F.sort_array(words), " "), F.lit("")),
        "_fg": F.coalesce(F.sort_array(grams), F.array().cast("array<smallint>")),
        "_n": F.coalesce(F.when(F.col("_grams").isNotNull(), F.size("_grams")), F.lit(0)),
        "_fe": F.coalesce(F.when(parts["extension"].isin(known), parts["extension"]), F.lit("")),
    }
    return f.withColumns(shape).select(*files.columns, *SHAPE)


def _met(entries: DataFrame, index: DataFrame) -> DataFrame:
    """``SHAPE, key, block``: shapes of files beside the sources ``(key, source)`` of their key, in blocks.

    A key that many shapes hold is dealt over several, and its sources
    are copied for each; the table of such keys has at most a row for ``CELL_FILES`` entries.
    """
    held = entries.groupBy("key").agg(F.ceil(F.count("*") / CELL_FILES).cast("int").alias("cells"))
    dealt = entries.join(F.broadcast(held.where("cells > 1")), "key", "left").withColumn("cell", F.pmod(F.xxhash64(*SHAPE), F.coalesce("cells", F.lit(1))).cast("int"))
    # sizes of tables that grow out of lists are not known beforehand, so no side of these joins may be sent to the driver
    used = index.join(held.hint("merge"), "key")
    blocks = used.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
    cut = used.join(blocks.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("source.source_id"), F.col("blocks")))
    cut = cut.groupBy("key", "part", "cells").agg(F.collect_list("source").alias("block"))
    copied = cut.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    return dealt.drop("cells").join(copied.hint("merge"), ["key", "cell"]).select(*SHAPE, "key", "block")


def _scored(met: DataFrame, mine: Callable[[Column], Column]) -> DataFrame:
    """``SHAPE, hits``: the sources of each block that are ``mine`` to score and reach the threshold."""
    ready = met.withColumn("_fw", F.split("_text", " "))

    def scored(s: Column) -> Column:
        both = F.size(s["_grams"]) + F.col("_n")
        overlap = F.size(F.array_intersect("_fw", s["_words"])) / F.greatest(F.size(s["_words"]), F.lit(1))
        likeness = F.when(both > 0, F.size(F.array_intersect("_fg", s["_grams"])) * 2 / both).otherwise(0.0)
        # named twice, as a column named once is worked out anew for each source
        bonus = F.when(F.col("_fe").isNotNull() & F.array_contains(s["_exts"], F.col("_fe")), EXTENSION_BONUS).otherwise(0.0)
        score = overlap * TOKEN_WEIGHT + likeness * NAME_WEIGHT + bonus
        return F.struct((-score).alias("minus"), s["position"].alias("position"), s["source_id"].alias("source_id"))

    hits = F.filter(F.transform(F.filter("block", mine), scored), lambda x: x["minus"] <= -THRESHOLD)
    # a filter on hits would be worked out with all its columns before they are; empty ones fall out later
    return ready.select(*SHAPE, hits.alias("hits"))


def _hits(shapes: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``SHAPE, hits`` of pairs with a shared word, each pair once, and of pairs without, as often as they share a rare bigram.

    A hit is ``minus, position, source_id``, so the least one is the best.
    """
    source = F.struct("source_id", "position", "_words", "_grams", "_exts").alias("source")
    words = F.filter(F.split("_text", " "), lambda w: w != "")
    by_word = _scored(
        _met(_unfolded(shapes, SHAPE, words, "key"), _unfolded(tracked, [source], F.col("_words"), "key")),
        lambda x: F.get(F.array_intersect("_fw", x["_words"]), F.lit(0)) == F.col("key"),
    )

    # a name of n bigrams that shares at least so many with another agrees with it on one of its first
    # n - that + 1 in any common order; those that no source holds come first in it
    counts = _gram_counts(tracked).scalar()
    ordered = shapes.withColumn("_counts", counts).withColumn("_ordered", _in_order("_fg", F.col("_counts")))
    rare = F.slice("_ordered", F.lit(1), F.greatest(F.size("_ordered") - _least_shared(F.col("_n")) + 1, F.lit(0)).cast("int"))
    named = tracked.withColumn("_counts", counts).withColumn("_ordered", _in_order("_grams", F.col("_counts")))
    first = F.slice("_ordered", F.lit(1), (F.size("_ordered") - _least_shared(F.size("_ordered")) + 1).cast("int"))
    grams = _met(_unfolded(ordered, SHAPE, rare, "key"), _unfolded(named, [source], first, "key"))
    by_name = _scored(grams, lambda x: ~F.arrays_overlap("_fw", x["_words"]))
    return by_word, by_name


def _pairs(shapes: DataFrame, tracked: DataFrame) -> DataFrame:
    """``SHAPE, source_id, position, score`` of every (shape, source) pair that reaches the threshold, once."""
    by_word, by_name = (_unfolded(h, SHAPE, F.col("hits"), "hit") for h in _hits(shapes, tracked))
    hit = F.col("hit")
    return by_word.unionByName(by_name.distinct()).select(*SHAPE, hit["source_id"].alias("source_id"), hit["position"].alias("position"), (-hit["minus"]).alias("score"))


def score_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Every (file, source) pair that reaches the threshold, with its score.

    Pairs come from inverted indexes, never from a product. Without a shared token a score
    needs names so alike that one of the rarest bigrams of each is shared, so only those are
    indexed. A pair with shared words is scored where the first of them meets. Files of one shape
    are scored as one.
    ``files(path)``, ``sources(source_id, position, category, document, subject, why_needed, format)``.
    """
    tracked = _tracked(sources)
    shaped = _shaped(files.select("path"), tracked)
    found = _pairs(shaped.select(*SHAPE).distinct(), tracked)
    return shaped.join(found.hint("merge"), list(SHAPE)).select("path", "source_id", "position", "score")


def route_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Each file with its single best source (ties to the first source), null when none reaches the threshold.

    The best source of a block is taken in its row, so a shape's pairs are never rows.
    """
    tracked = _tracked(sources)
    shaped = _shaped(files, tracked)
    by_word, by_name = _hits(shaped.select(*SHAPE).distinct(), tracked)
    best = by_word.unionByName(by_name).select(*SHAPE, F.array_min("hits").alias("hit")).groupBy(*SHAPE).agg(F.min("hit").alias("hit"))
    best = best.select(*SHAPE, F.col("hit.source_id").alias("source_id"), (-F.col("hit.minus")).alias("score"))
    others = [c for c in files.columns if c != "path"]
    return shaped.join(best.hint("merge"), list(SHAPE), "left").select("path", *others, "source_id", "score")


def top_matches(files: DataFrame, sources: DataFrame, keep: int = TOP_FILES) -> DataFrame:
    """The best files of every source, each file counted for every source it fits.

    Files of one shape tie, so no more than the first ``keep`` of them can be among a source's best.
    """
    tracked = _tracked(sources)
    alike = Window.partitionBy(*SHAPE).orderBy("path")
    first = _shaped(files.select("path"), tracked).withColumn("_rn", F.row_number().over(alike)).where(F.col("_rn") <= keep).drop("_rn")
    found = _pairs(first.select(*SHAPE).distinct(), tracked)
    ranked = Window.partitionBy("source_id").orderBy(F.col("score").desc(), "path")
    scored = first.join(found.hint("merge"), list(SHAPE))
    return scored.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= keep).select("source_id", "place", "path", "score")


def obtained_flag(value: Column | str) -> Column:
    v = F.lower(F.trim(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))))
    return v.isin("true", "yes", "y") | v.contains("✓") | v.contains("☑")


def source_coverage(sources: DataFrame, routed: DataFrame, keep: int = TOP_FILES) -> DataFrame:
    """Each source with its obtained flag, file count and best files."""
    matched = routed.where(F.col("source_id").isNotNull())
    ranked = Window.partitionBy("source_id").orderBy(F.col("score").desc(), "path")
    counts = matched.groupBy("source_id").agg(F.count("*").alias("matched_files"))
    best = (
        matched.withColumn("_rn", F.row_number().over(ranked))
        .where(F.col("_rn") <= keep)
        .groupBy("source_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("place"), "path", F.round("score", 3).alias("score")))).alias("best_files"))
    )
    flagged = obtained_flag("obtained")
    return (
        sources.join(counts, "source_id", "left")
        .join(best, "source_id", "left")
        .withColumn("matched_files", F.coalesce("matched_files", F.lit(0)).cast("bigint"))
        .withColumn("is_obtained", flagged | (F.col("matched_files") > 0))
        .withColumn("obtained_by", F.when(flagged, "tracker").when(F.col("matched_files") > 0, "filesystem").otherwise("none"))
    )


def category_id(category: Column | str = "category") -> Column:
    """The single-letter prefix of a category label, else the label."""
    c = F.col(category) if isinstance(category, str) else category
    letter = F.regexp_extract(c, r"^([A-Za-z])\.\s", 1)
    return F.when(letter != "", F.upper(letter)).otherwise(F.trim(c))


# Reviewed dispositions, first match wins.
# (status, scope, category ids or None, words any of which must occur, words none of which may)
DISPOSITIONS = (
    ("resolved", "transaction_enrichment", None, ("dog grooming", "daycare", "boarding"), ()),
    ("deferred_planning", "financial_planning_ref", ("E", "I"), (), ()),
    ("deferred_planning", "financial_planning_ref", ("F",), (), ("rent payment history",)),
    ("deferred_planning", "financial_planning_ref", ("D",), ("household service contract",), ()),
    ("deferred_planning", "financial_planning_ref", ("G",), ("hsa statement",), ()),
    ("deferred_planning", "financial_planning_ref", ("G",), ("deductible", "oop-max", "oop max"), ()),
    ("not_needed", "transaction_enrichment", None, ("venmo", "paypal", "zelle", "cash app"), ()),
    ("not_needed", "transaction_enrichment", None, ("amazon order history", "instacart", "grocery delivery"), ()),
    ("not_needed", "transaction_enrichment", ("H",), (), ()),
    ("not_needed", "transaction_enrichment", ("D",), ("electric", "gas", "water", "internet", "cell phone", "security system"), ()),
)


def dispositions(coverage: DataFrame) -> DataFrame:
    """Coverage rows with their category id, disposition and scope."""
    text = F.lower("document")
    status = scope = None
    for name, area, ids, words, without in DISPOSITIONS:
        condition = F.lit(True)
        if ids:
            condition = condition & F.col("category_id").isin(*ids)
        if words:
            condition = condition & text.rlike("|".join(w.replace("-", r"\-") for w in words))
        for word in without:
            condition = condition & ~text.contains(word)
        status = F.when(condition, name) if status is None else status.when(condition, name)
        scope = F.when(condition, area) if scope is None else scope.when(condition, area)
    status = status.otherwise(F.when(F.col("is_obtained"), "resolved").otherwise("open"))
    return coverage.withColumn("category_id", category_id()).withColumns(
        {"disposition": status, "scope": scope.otherwise("transaction_enrichment")}
    )


def category_summary(reviewed: DataFrame) -> DataFrame:
    """Total, obtained and missing sources per category."""
    return reviewed.groupBy("category", "category_id").agg(
        F.count("*").alias("total"),
        F.count_if("is_obtained").alias("obtained"),
        F.count_if(~F.col("is_obtained")).alias("missing"),
    )


def readiness(reviewed: DataFrame) -> DataFrame:
    """Essential sources ready, in all and as a percentage, over the sources still on the worklist."""
    active = reviewed.where(F.col("disposition").isin("open", "resolved"))
    essential = F.col("priority").contains("Essential")
    ready = F.count_if(essential & F.col("is_obtained"))
    total = F.count_if(essential)
    return active.agg(
        total.alias("essential"),
        ready.alias("essential_ready"),
        F.greatest(total - ready, F.lit(0)).alias("essential_gap"),
        F.count_if(~F.col("is_obtained") & ~essential).alias("open_later"),
        F.when(total > 0, F.round(ready / total * 100, 2)).otherwise(0.0).alias("readiness_pct"),
    )


def dispatch(routed: DataFrame, layout_of_source: dict[str, str] | DataFrame) -> DataFrame:
    """Each routed file with the layout of its source; ``no_parser`` when there is none.

    Layouts come as a mapping or as a table ``source_id, layout`` of any length.
    """
    if isinstance(layout_of_source, dict):
        kind = "source_id string, layout string"
        layout_of_source = routed.sparkSession.createDataFrame(sorted(layout_of_source.items()), kind)
    named = routed.join(layout_of_source.select("source_id", "layout"), "source_id", "left").select(*routed.columns, "layout")
    return named.withColumn("status", F.when(F.col("layout").isNull(), "no_parser").otherwise("routed"))


def parse_records(found: DataFrame | Mapping[str, DataFrame], specs: Sequence[Layout]) -> tuple[DataFrame, DataFrame]:
    """Parsed rows of records of all layouts at once, and ``source_document_name, layout, reason`` of files that lack columns.

    ``found`` has ``header, record, layout, source_document_name``; every file's columns are taken by
    its own header. Records that come apart, as a mapping from the layout's name, are parsed apart: the
    steps of one layout are short enough for the JVM to compile, those of all in one are not.
    """
    if not isinstance(found, DataFrame):
        apart = [_parse_layout(found[spec.name], spec) for spec in specs if spec.name in found]
        return tuple(reduce(DataFrame.unionByName, frames) for frames in zip(*apart))
    named = found.withColumn("names", records.clean_names(F.col("header")))
    lacking = None
    for spec in specs:
        here = F.col("layout") == spec.name
        lacking = F.when(here, records.missing(spec.required)) if lacking is None else lacking.when(here, records.missing(spec.required))
    good = named.where(F.size(lacking) == 0).withColumn("values", records.fields(F.col("record")))
    wanted = dict.fromkeys(name for spec in specs for name in (*spec.required, *spec.optional))
    raw = good.select("layout", "source_document_name", *[records.column(name).alias(name) for name in wanted])
    reason = F.concat(F.lit("missing required columns: "), F.array_join(lacking, ", "))
    failed = named.where(F.size(lacking) > 0).select("source_document_name", "layout", reason.alias("reason")).distinct()
    return parse(raw, specs), failed


def _parse_layout(found: DataFrame, spec: Layout) -> tuple[DataFrame, DataFrame]:
    named = found.withColumn("names", records.clean_names(F.col("header")))
    lacking = records.missing(spec.required)
    good = named.where(F.size(lacking) == 0).withColumn("values", records.fields(F.col("record")))
    raw = good.select("source_document_name", *[records.column(name).alias(name) for name in (*spec.required, *spec.optional)])
    reason = F.concat(F.lit("missing required columns: "), F.array_join(lacking, ", "))
    failed = named.where(F.size(lacking) > 0).select("source_document_name", F.lit(spec.name).alias("layout"), reason.alias("reason")).distinct()
    return parse(raw, spec), failed


def parse_routed(dispatched: DataFrame, paths: str | Sequence[str], specs: Sequence[Layout]) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and files that lack columns, of all routed files below ``paths``: one scan, one plan.

    ``dispatched`` has ``path`` and ``layout``. Files without a layout are left out; no path goes
    through the driver.
    """
    found = records.read_records(dispatched.sparkSession, paths)
    bare = F.regexp_replace("path", "^file:/+", "/")
    routed = dispatched.where(F.col("layout").isNotNull()).select(bare.alias("_bare"), "layout").distinct()
    return parse_records(found.join(routed, bare == F.col("_bare")), specs)

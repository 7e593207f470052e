"""Records of delimited text files of any size, one file over many tasks.

Files are read as lines, so Spark splits them anywhere. Whether a line starts inside a quoted field
depends on all lines before it; but a line does one of four things to that: it leaves it as it was,
turns it round, or sets it, whatever it was, to inside or outside. Such steps add up, so they are added
up twice: over the lines of a block in the task that holds the block, and over the blocks of a file,
one row each. Records that span lines are then put together; all others are lines as they are.

Headers are data too: the first line of a file's first block goes to the file's other blocks with
their state. No path, header or line goes through the driver, and files are read while the result is,
not before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ("path", "block")

# A quoted field up to its closing quote, doubled quotes inside; nothing is tried twice.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
# Whole fields from the start of a line, each with its comma.
_FIELDS = rf'^(?:"{_QUOTED}"[^,]*+,|(?!")[^,]*+,)++'


def ends_inside(line: Column) -> Column:
    """Whether a line that starts outside of quotes ends inside: its last field opens one and leaves it open.

    A quote opens a field only as its first sign; anywhere else it is a sign like others.
    """
    last = F.regexp_replace(line, _FIELDS, "")
    return last.rlike(rf'^"{_QUOTED}$')


def ends_inside_from_inside(line: Column) -> Column:
    """The same for a line that starts inside of quotes."""
    rest = F.regexp_replace(line, rf'^{_QUOTED}"(?!")[^,]*+,?', "")
    closed = line.rlike(rf'^{_QUOTED}"(?!")')
    return F.when(closed, ends_inside(rest)).otherwise(True)


def _with_state(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds up steps ``out`` and ``into`` (state afterwards from outside, from inside) in order.

    ``mark`` and ``turn`` give the state before a row from the state ``s`` before the first one:
    ``coalesce(mark, s) <> turn``; ``mark_to`` and ``turn_to`` the state after it.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum((F.col("out") & ~F.col("into")).cast("int")).over(upto) % 2 == 1
    # a row that sets the state says what it would have been without the turns so far
    steps = df.withColumn("turn_to", turns).withColumn("_set", F.when(F.col("out") == F.col("into"), F.col("out") != F.col("turn_to")))
    steps = steps.withColumn("mark_to", F.last("_set", ignorenulls=True).over(upto))
    in_order = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(F.struct("mark_to", "turn_to")).over(in_order)
    steps = steps.withColumn("_before", before)
    return steps.withColumn("mark", F.col("_before.mark_to")).withColumn("turn", F.coalesce("_before.turn_to", F.lit(False))).drop("_set", "_before")


def lines_of(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, source_document_name, block, line, value``; ``line`` ascends inside a block."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("source_document_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, source_document_name, header, record`` of every record after a file's header line.

    Lines of nothing but blanks between records are left out. A quote that is never closed holds the
    rest of its file.
    """
    lines = lines_of(spark, paths).withColumn("out", ends_inside(F.col("value"))).withColumn("into", ends_inside_from_inside(F.col("value")))
    steps = _with_state(lines, BLOCK, "line")

    last = F.struct("line", "mark_to", "turn_to")
    blocks = steps.groupBy(*BLOCK).agg(F.max(last).alias("l"), F.min_by("value", "line").alias("first_value"))
    blocks = blocks.select(
        *BLOCK, "first_value",
        (F.coalesce("l.mark_to", F.lit(False)) != F.col("l.turn_to")).alias("out"), (F.coalesce("l.mark_to", F.lit(True)) != F.col("l.turn_to")).alias("into"),
    )
    whole_file = Window.partitionBy("path").orderBy("block")
    blocks = _with_state(blocks, ["path"], "block").select(
        F.col("path").alias("_path"), F.col("block").alias("_block"), F.first("first_value").over(whole_file).alias("header"),
        (F.row_number().over(whole_file) == 1).alias("first_block"), (F.coalesce("mark", F.lit(False)) != F.col("turn")).alias("start"),
    )

    placed = steps.join(blocks, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    in_block = Window.partitionBy(*BLOCK).orderBy("line")
    inside = F.coalesce("mark", F.col("start")) != F.col("turn")
    placed = placed.withColumn("inside", inside).withColumn("is_header", F.col("first_block") & (F.row_number().over(in_block) == 1))
    placed = placed.where(~F.col("is_header") & (F.col("inside") | (F.trim("value") != "")))
    starts = F.sum((~F.col("inside")).cast("int")).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("number", starts)
    opens = F.when(F.col("inside"), F.col("into")).otherwise(F.col("out"))
    single = ~F.col("inside") & ~opens
    head = ("path", "source_document_name", "header")
    alone = placed.where(single).select(*head, F.col("value").alias("record"))

    parts = placed.where(~single)
    # lines that go on with a record of an earlier block find it by the last start before their block
    ends = parts.groupBy(*BLOCK).agg(F.max(F.when(~F.col("inside"), F.col("number"))).alias("last"))
    earlier = whole_file.rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(F.when(F.col("last").isNotNull(), F.struct("block", "last")), ignorenulls=True).over(earlier)
    ends = ends.select(F.col("path").alias("_p"), F.col("block").alias("_b"), carry.alias("carry"))
    owned = parts.join(ends, (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b")))
    own = F.when(F.col("number") > 0, F.struct("block", F.col("number").alias("last"))).otherwise(F.col("carry"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n")
    return alone.unionByName(owned.withColumn("own", own).groupBy(*head, "own").agg(joined.alias("record")).select(*head, "record"))


def fields(record: Column) -> Column:
    """Fields of a record: quotes taken off, doubled quotes made one; null where nothing stands."""
    cut = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(rf'(?s)("{_QUOTED}"[^,]*+|(?!")[^,]*+|".*),'), F.lit(1))

    def plain(field: Column) -> Column:
        quoted = F.regexp_replace(F.regexp_replace(field, rf'(?s)^"({_QUOTED})"?(.*)$', "$1$2"), '""', '"')
        return F.when(field == "", F.lit(None).cast("string")).when(field.startswith('"'), quoted).otherwise(field)

    # most records hold no quote, so they are cut at their commas
    bare = F.transform(F.split(record, ","), lambda field: F.nullif(field, F.lit("")))
    return F.when(record.contains('"'), F.transform(cut, plain)).otherwise(bare)


def clean_names(header: Column) -> Column:
    """Header fields as column names: BOM and blanks dropped, lower case, other characters as ``_``."""

    def clean(name: Column) -> Column:
        word = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "_")
        return F.regexp_replace(word, "^_+|_+$", "")

    text = F.regexp_replace(header, "\ufeff", "")
    # a header without quotes is cleaned whole; Spark does that once for a header that is a literal
    words = F.regexp_replace(F.lower(text), "[^a-z0-9,]+", "_")
    bare = F.split(F.regexp_replace(F.regexp_replace(words, "(^|,)_+", "$1"), "_+(?=,|$)", ""), ",")
    return F.when(text.contains('"'), F.transform(fields(text), clean)).otherwise(bare)


def column(name: str) -> Column:
    """The value of a named column, by the header's ``names`` and the record's ``values``; null where the header lacks it."""
    return F.get("values", (F.array_position("names", name) - 1).cast("int"))


def missing(required: Sequence[str]) -> Column:
    """Names of ``required`` that ``names`` lacks, in order."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("names")))

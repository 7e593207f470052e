"""Set-based helpers shared by the operators.

Windows here run on calendar-bounded grains (one row per key and day, or key and
month), so a hot key never puts an unbounded number of rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ranges import number_in_group
from tallyframe.session import cut_lineage

HOUSEHOLD = ("household_id",)

# Least tasks for rows that shrink much in a shuffle or unfold after it: Spark joins partitions by their written
# bytes, so tasks would hold millions of such rows.
SPREAD = 128
# Keys that such a task holds on average at most; beyond, there are more tasks and not more keys in each.
KEYS_IN_TASK = 2_500


def spread(keys: DataFrame) -> int:
    """Tasks for rows dealt by a key, from the number of rows of ``keys``, which holds each key once. It counts them."""
    return max(SPREAD, math.ceil(keys.count() / KEYS_IN_TASK))


def as_day(value: date | str | Column) -> Column:
    """A date literal from a Python date or ISO text."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def month_spine(days: DataFrame, keys: Sequence[str], day: str = "occurred_on") -> DataFrame:
    """One row per key and calendar month between the key's first and last ``day``."""
    ends = days.groupBy(*keys).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    months = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))
    return ends.select(*keys, F.explode(months).alias("month_start"))


def as_of_values(
    points: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    point_day: str,
    mark_day: str,
    values: Sequence[str],
    *,
    fallback_first: bool = True,
) -> DataFrame:
    """For each distinct (keys, day) of ``points``: ``values`` of the latest mark on or before it.

    Days before the first mark take the first mark when ``fallback_first``. Points and
    marks are merged and scanned once in date order, so no pair of them is ever built.
    """
    payload = F.struct(*values)
    asked = points.select(*keys, F.col(point_day).alias("_day")).distinct()
    asked = asked.select("*", F.lit(1).alias("_asked"), F.lit(None).cast(marks.select(payload).schema[0].dataType).alias("_mark"))
    known = marks.select(*keys, F.col(mark_day).alias("_day"), F.lit(0).alias("_asked"), payload.alias("_mark"))
    ordered = Window.partitionBy(*keys).orderBy("_day", "_asked")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.last("_mark", ignorenulls=True).over(upto)
    if fallback_first:
        found = F.coalesce(found, F.first("_mark", ignorenulls=True).over(whole))
    return (
        known.unionByName(asked)
        .withColumn("_found", found)
        .where("_asked = 1")
        .select(*keys, F.col("_day").alias(point_day), *[F.col("_found")[v].alias(v) for v in values])
    )


def mark_intervals(marks: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Dated settings as ``[_from, _to)`` intervals; the first one also covers every day before it.

    For short configuration tables: a row finds its setting with an equi-join on ``keys``
    and a range condition, which holds for exactly one interval.
    """
    in_order = Window.partitionBy(*keys).orderBy(day)
    first = F.lag(day).over(in_order).isNull()
    return (
        marks.withColumn("_from", F.when(first, F.lit("0001-01-01").cast("date")).otherwise(F.col(day)))
        .withColumn("_to", F.coalesce(F.lead(day).over(in_order), F.lit("9999-12-31").cast("date")))
        .drop(day)
    )


def join_interval(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    same = [F.col(f"r.{k}") == F.col(f"i.{k}") for k in keys]
    inside = (F.col(f"r.{day}") >= F.col("i._from")) & (F.col(f"r.{day}") < F.col("i._to"))
    condition = inside
    for equal in same:
        condition = equal & condition
    values = [F.col(f"i.{c}") for c in intervals.columns if c not in (*keys, "_from", "_to")]
    return rows.alias("r").join(intervals.alias("i"), condition).select("r.*", *values)


COPY_CHUNK = 10_000

# Rows of a group that one task numbers at most.
LARGE_GROUP = 1_000_000


def number_copies(df: DataFrame, keys: Sequence[str], digest: Column, name: str = "ordinal") -> DataFrame:
    """0-based ordinal of each row inside its group, in digest order; equal rows count on.

    Groups are numbered by a window, so rows are shuffled once, and not at all where nobody asks for the number.
    Larger ones are found by counting, first the rows of each value of the first key, then the groups of
    values with many; their equal rows are folded and the rest is spread over tasks.
    """
    large = _large_groups(df, keys[:1])
    if large is not None and len(keys) > 1:
        large = _large_groups(_in_groups(df, large, keys[:1], "left_semi"), keys)
    if large is None:
        return _number_in_tasks(df, keys, digest, name)
    folded = _number_folded(_in_groups(df, large, keys, "left_semi"), keys, digest, name)
    return _number_in_tasks(_in_groups(df, large, keys, "left_anti"), keys, digest, name).unionByName(folded)


def _large_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys of groups with more than ``LARGE_GROUP`` rows, at most one for as many rows of ``df``."""
    found = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE_GROUP).select(*keys))
    return None if found.isEmpty() else found


def _in_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    named = groups.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    return df.join(F.broadcast(named), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]), how)


def _number_in_tasks(df: DataFrame, keys: Sequence[str], digest: Column, name: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(digest))
    return df.withColumn(name, (place - 1).cast("bigint"))


def _number_folded(df: DataFrame, keys: Sequence[str], digest: Column, name: str) -> DataFrame:
    """Equal rows are folded into one row with a count before anything is ordered, and are
    unfolded afterwards, so a group made of copies never sits in one task.
    """
    columns = df.columns
    folded = df.groupBy(*columns).agg(F.count("*").alias("_copies")).withColumn("_digest", digest)
    placed = number_in_group(folded, keys, ["_digest"], name="_first", weight="_copies")
    # Many copies unfold in chunks, and chunks are spread by size before they unfold.
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPY_CHUNK))
    spread = placed.withColumn("_chunk", F.explode(chunks)).hint("rebalance")
    low = F.col("_chunk") * COPY_CHUNK
    places = F.sequence(low, F.least(low + COPY_CHUNK, F.col("_copies")) - 1)
    return spread.withColumn("_i", F.explode(places)).select(*columns, (F.col("_first") - 1 + F.col("_i")).alias(name))


def newest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (pruned before the shuffle by the group limit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")

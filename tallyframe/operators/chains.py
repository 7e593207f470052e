"""Intraday running-balance chains.

A row with balance ``b`` and amount ``a`` is an edge from ``b - a`` to ``b``. The rows of
an account-day form one chain when they link into a single path. All degree tests are
counts per balance value; days that pass them may still hide a closed loop beside the path,
so they are walked: edges are contracted over all tasks first, and what is left of a day in its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators.common import as_of_values

ACCOUNT_DAY = ("account_id", "occurred_on")

# Each round joins about a third of a path's edges to their followers, so 8 rounds leave one in 25.
ROUNDS = 8
# What is left of a day is looked up in so many small maps, as a map is searched from its start.
DRAWERS = 64


def _value_degrees(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges entering, leaving and looping at each balance value of an account-day."""
    edges = rows.select(
        *keys, S.cents("running_balance").alias("b"), (S.cents("running_balance") - S.cents("amount")).alias("p")
    )
    ends = F.array(
        F.struct(F.col("b").alias("v"), F.lit(1).alias("into"), F.lit(0).alias("out")),
        F.struct(F.col("p").alias("v"), F.lit(0).alias("into"), F.lit(1).alias("out")),
    )
    loop = F.array(F.struct(F.col("b").alias("v"), F.lit(0).alias("into"), F.lit(0).alias("out")))
    return (
        edges.select(*keys, (F.col("b") == F.col("p")).cast("int").alias("loop"), F.when(F.col("b") == F.col("p"), loop).otherwise(ends).alias("e"))
        .select(*keys, "loop", F.explode("e").alias("e"))
        .select(*keys, "loop", "e", F.col("e.v").alias("v"))
        .repartition(*keys, "v")
        .groupBy(*keys, "v")
        .agg(F.sum("e.into").alias("into"), F.sum("e.out").alias("out"), F.sum("loop").alias("loops"))
    )


def _day_shape(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fork, head and terminal counts of each account-day with its candidate opening and closing."""
    into, out, loops = F.col("into"), F.col("out"), F.col("loops")
    fork = (
        ((into > 0) & (out + loops > 1))
        | ((out > 0) & (into + loops > 1))
        | ((loops > 0) & ((out + loops > 2) | (into + loops > 2)))
    )
    terminals = F.when(out + loops == 0, into).otherwise(0) + F.when((loops > 0) & (out + loops == 1), loops).otherwise(0)
    heads = F.when(into + loops == 0, out).otherwise(0) + F.when((loops > 0) & (into + loops == 1), loops).otherwise(0)
    marked = values.withColumn("t", terminals).withColumn("h", heads).withColumn("fork", fork)
    return marked.groupBy(*keys).agg(
        F.max("fork").alias("forked"),
        F.sum("t").alias("terminals"),
        F.sum("h").alias("heads"),
        (F.sum("into") + F.sum("loops")).alias("row_count"),
        F.sum("into").alias("edge_count"),
        F.max(F.when((F.col("into") > 0) | (F.col("loops") > 0), F.col("v"))).alias("highest"),
        F.max(F.when(F.col("t") > 0, F.col("v"))).alias("last_value"),
        F.max(F.when(F.col("h") > 0, F.col("v"))).alias("first_value"),
    )


def contract(edges: DataFrame, keys: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """Paths and loops of ``edges`` (``keys, at, to``; one edge in and one out of a value at most) made shorter.

    Each round draws a number per value and sends every edge to that end which drew more. Where the
    edge into a value meets the edge out of it, the two become one. So ends of paths stay, a loop
    shrinks to an edge from a value to itself, and a day of any length is spread over its values.
    A round is one aggregation: the plan grows by one step and nothing runs while it is built. Values are
    dealt anew in each, as rows dealt by day would run all rounds, and a whole day, in one task.
    """
    for number in range(rounds):
        draw = [F.xxhash64(F.lit(number), F.col(end)) for end in ("at", "to")]
        met = edges.select(*keys, "at", "to", F.when(draw[0] > draw[1], F.col("at")).otherwise(F.col("to")).alias("v"))
        ends = met.repartition(*keys, "v").groupBy(*keys, "v").agg(
            F.max(F.when(F.col("to") == F.col("v"), F.col("at"))).alias("came"), F.max(F.when(F.col("at") == F.col("v"), F.col("to"))).alias("goes")
        )
        edges = ends.select(*keys, F.coalesce("came", "v").alias("at"), F.coalesce("goes", "v").alias("to"))
    return edges


def _walk(rows: DataFrame, days: DataFrame, keys: Sequence[str], rounds: int) -> DataFrame:
    """Where the walk from a day's head ends after all of its edges: ``(keys, end)``, null where it stops short.

    Days that are no path by their counts lose edges on the way, but they are not in ``days``.
    """
    edges = rows.select(*keys, (S.cents("running_balance") - S.cents("amount")).alias("at"), S.cents("running_balance").alias("to")).where("`at` <> `to`")
    drawer = F.pmod(F.xxhash64("at"), F.lit(DRAWERS))
    left = contract(edges, keys, rounds).join(days.select(*keys, "first_value"), list(keys)).withColumn("drawer", drawer)
    drawers = left.groupBy(*keys, "drawer").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "to"))).alias("next"), F.count("*").alias("steps"), F.first("first_value").alias("first_value")
    )
    steps = drawers.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("drawer", "next"))).alias("next"), F.sum("steps").alias("steps"), F.first("first_value").alias("first_value")
    )

    def following(at: Column) -> Column:
        return F.try_element_at(F.try_element_at(F.col("next"), F.pmod(F.xxhash64(at), F.lit(DRAWERS))), at)

    walked = F.aggregate(F.sequence(F.lit(1), F.col("steps").cast("int")), F.col("first_value"), lambda at, _: following(at))
    return steps.select(*keys, walked.alias("end"))


def intraday_chains(rows: DataFrame, keys: Sequence[str] = ACCOUNT_DAY, rounds: int = ROUNDS) -> DataFrame:
    """Opening, closing and ambiguity of every account-day of rows that carry ``running_balance``.

    Row order is never read. A fork, a gap, a duplicate or a closed loop makes the day ambiguous.
    """
    keys = list(keys)
    rows = rows.where(F.col("running_balance").isNotNull())
    days = _day_shape(_value_degrees(rows, keys), keys)
    linked = (~F.col("forked")) & (F.col("terminals") == 1) & (F.col("heads") == 1)
    # A loop takes two edges; the path beside it may be a lone zero row without any.
    needs_walk = linked & (F.col("edge_count") >= 2)
    days = days.withColumn("linked", linked).withColumn("needs_walk", needs_walk)
    ends = _walk(rows, days.where("needs_walk"), keys, rounds)
    ambiguous = ~F.col("linked") | (F.col("needs_walk") & ~F.coalesce(F.col("end") == F.col("last_value"), F.lit(False)))
    alone = F.col("row_count") == 1
    return (
        days.join(ends, keys, "left")
        .withColumn("ambiguous", ~alone & ambiguous)
        .select(
            *keys,
            "row_count",
            "ambiguous",
            _money(F.when(~F.col("ambiguous"), F.col("first_value"))).alias("opening"),
            _money(F.when(~F.col("ambiguous"), F.col("last_value"))).alias("closing"),
            _money(F.col("highest")).alias("highest_balance"),
        )
    )


def _money(value: Column) -> Column:
    return (value.cast("decimal(20,0)") / 100).cast("decimal(18,2)")


def day_closings(rows: DataFrame) -> DataFrame:
    """Closing and its source of every account-day with running balances; the highest one where the order is unclear."""
    return intraday_chains(rows).select(
        *ACCOUNT_DAY, F.coalesce("closing", "highest_balance").alias("closing"),
        F.when(F.col("ambiguous"), "running_balance_unresolved").otherwise("running_balance").alias("closing_source"),
    )


def _active_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ACCOUNT_DAY).agg(F.count("*").alias("day_rows"), F.count("running_balance").alias("balance_rows"))


def closing_by_day(rows: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Per account and active day: closing by running balance, or null when the day has none.

    An ambiguous day falls back to its highest balance and says so. ``active`` may be some of the days only.
    """
    active = _active_days(rows) if active is None else active
    chains = intraday_chains(rows).drop("row_count")
    return active.join(chains, list(ACCOUNT_DAY), "left").select(
        *active.columns,
        "opening",
        F.coalesce("closing", "highest_balance").alias("closing"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
        F.when(F.col("balance_rows") == 0, F.lit(None).cast("string"))
        .when(F.col("ambiguous"), "running_balance_unresolved")
        .otherwise("running_balance")
        .alias("closing_source"),
    )


def statement_closings(points: DataFrame, rows: DataFrame) -> DataFrame:
    """Running-balance closing of the last active day on or before each ``(account_id, period_end)``.

    There is no lower bound: an idle period inherits an older day.
    """
    days = closing_by_day(rows).withColumn("closing_day", F.col("occurred_on"))
    return as_of_values(
        points, days, ["account_id"], "period_end", "occurred_on",
        ["closing", "closing_source", "closing_day"], fallback_first=False,
    )


def month_chains(rows: DataFrame) -> DataFrame:
    """Opening of the first and closing of the last active day per account and month, with breaks.

    Only accounts whose every row carries a balance are chained.
    """
    every = Window.partitionBy("account_id")
    gaps = F.sum(F.col("day_rows") - F.col("balance_rows")).over(every)
    days = closing_by_day(rows, _active_days(rows).withColumn("gap_rows", gaps).where("gap_rows = 0"))
    payload = F.struct("occurred_on", "opening", "closing", "ambiguous")
    months = days.groupBy("account_id", F.trunc("occurred_on", "month").alias("month_start")).agg(
        F.min(payload).alias("first"), F.max(payload).alias("last")
    )
    in_order = Window.partitionBy("account_id").orderBy("month_start")
    months = months.select(
        "account_id",
        "month_start",
        F.col("first.occurred_on").alias("first_day"),
        F.col("last.occurred_on").alias("last_day"),
        F.when(~F.col("first.ambiguous"), F.col("first.opening")).alias("opening"),
        F.when(~F.col("last.ambiguous"), F.col("last.closing")).alias("closing"),
        F.col("first.ambiguous").alias("opening_ambiguous"),
        F.col("last.ambiguous").alias("closing_ambiguous"),
    )
    prior = F.lag("closing").over(in_order)
    return (
        months.withColumn("prior_month", F.lag("month_start").over(in_order))
        .withColumn("prior_closing", prior)
        .withColumn("broken", F.coalesce(F.col("opening") != F.col("prior_closing"), F.lit(False)))
    )


def partly_balanced_accounts(rows: DataFrame) -> DataFrame:
    """Accounts where some rows carry a running balance and some do not."""
    counts = rows.groupBy("account_id").agg(F.count("*").alias("n"), F.count("running_balance").alias("with_balance"))
    return counts.where((F.col("with_balance") > 0) & (F.col("with_balance") < F.col("n"))).select("account_id")

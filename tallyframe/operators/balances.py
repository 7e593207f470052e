"""Anchored balances, anchor seeding, checkpoints and period reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators.chains import day_closings
from tallyframe.operators.common import as_day, as_of_values, spread

ACCOUNT = "account_id"
PERIOD_KEY = (ACCOUNT, "period_start", "period_end")

# Closing sources, note prefix, staleness age.
OPENING_SOURCE = "opening_seed"
CLOSING_SOURCE = "statement"
CHECKPOINT_SOURCE = "checkpoint"
CHECKPOINT_NOTE = "Checkpoint re-anchor:"
CHECKPOINT_STALE_DAYS = 35


def zero() -> Column:
    return F.lit(0).cast("decimal(28,2)")


def day_breakdown(ledger: DataFrame, *more: Column) -> DataFrame:
    """Inflow, outflow, transfers in and out per account and day, and ``more`` of it."""
    amount, direction = F.col("amount"), F.col("direction")
    moved_in = (direction == "transfer") & (amount >= 0)
    moved_out = (direction == "transfer") & (amount < 0)

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), zero())

    return ledger.groupBy(ACCOUNT, "occurred_on").agg(
        total(direction == "inflow", amount).alias("inflows"),
        total(direction == "outflow", F.abs(amount)).alias("outflows"),
        total(moved_in, amount).alias("transfers_in"),
        total(moved_out, F.abs(amount)).alias("transfers_out"),
        *more,
    )


FLOWS = ("inflows", "outflows", "transfers_in", "transfers_out")


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def net_flow() -> Column:
    return F.col("inflows") + F.col("transfers_in") - F.col("outflows") - F.col("transfers_out")


def period_breakdown(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    """Flows per account and period; periods may split a month but not span two.

    A month's days travel as one array of at most 31 entries, so every period needs a
    single join and sums its own days in place.
    """
    days = day_breakdown(ledger)
    months = days.groupBy(ACCOUNT, F.trunc("occurred_on", "month").alias("_month")).agg(
        F.collect_list(F.struct("occurred_on", *FLOWS)).alias("_days")
    )
    joined = periods.withColumn("_month", F.trunc("period_start", "month")).join(months, [ACCOUNT, "_month"], "left")
    inside = F.filter("_days", lambda d: d["occurred_on"].between(F.col("period_start"), F.col("period_end")))

    def total(name: str) -> Column:
        return F.coalesce(F.aggregate("_days", zero(), lambda acc, d: (acc + d[name]).cast("decimal(28,2)")), zero()).alias(name)

    kept = [c for c in periods.columns]
    return (
        joined.withColumn("_days", inside)
        .select(*kept, *[total(f) for f in FLOWS])
        .withColumn("net", net_flow().cast("decimal(28,2)"))
    )


def _months_between(start: date | str, end: date | str) -> Column:
    first, last = F.trunc(as_day(start), "month"), as_day(end)
    return F.when(last >= as_day(start), F.sequence(first, F.greatest(last, first), F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )


def months_in_range(keys: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Calendar months from ``start``'s month to ``end`` per key row; the last one is clipped to ``end``."""
    return keys.select("*", F.explode(_months_between(start, end)).alias("period_start")).withColumn(
        "period_end", F.least(F.last_day("period_start"), as_day(end))
    )


def latest_anchor(periods: DataFrame) -> DataFrame:
    """The newest period with a statement closing per account."""
    return (
        periods.where(F.col("statement_closing").isNotNull())
        .groupBy(ACCOUNT)
        .agg(F.max(F.struct("period_end", "statement_closing")).alias("a"))
        .select(ACCOUNT, F.col("a.period_end").alias("anchor_date"), F.col("a.statement_closing").alias("anchor_balance"))
    )


def computed_balances(ledger: DataFrame, accounts: DataFrame, periods: DataFrame, as_of: date | str) -> DataFrame:
    """Balance per account: newest anchor plus everything posted after it up to ``as_of``.

    A card balance is the amount owed, so its movements are negated. No anchor, no balance.
    """
    day = as_day(as_of)
    anchors = latest_anchor(periods)
    daily = ledger.where(F.col("occurred_on") <= day).groupBy(ACCOUNT, "occurred_on").agg(F.sum(S.posted_effect()).alias("moved"))
    since = (
        daily.join(anchors, ACCOUNT)
        .where(F.col("occurred_on") > F.col("anchor_date"))
        .groupBy(ACCOUNT)
        .agg(F.sum("moved").alias("moved"))
    )
    sign = F.when(F.col("account_type") == "credit_card", -1).otherwise(1)
    net = F.when(F.col("anchor_date").isNotNull(), (F.coalesce("moved", zero()) * sign).cast("decimal(28,2)"))
    return (
        accounts.join(anchors, ACCOUNT, "left")
        .join(since, ACCOUNT, "left")
        .select(
            ACCOUNT,
            "account_type",
            "anchor_date",
            "anchor_balance",
            net.alias("net_since_anchor"),
            (F.col("anchor_balance") + net).cast("decimal(28,2)").alias("computed_balance"),
            day.alias("as_of_date"),
        )
    )


def empty_periods(spark: SparkSession) -> DataFrame:
    from tallyframe.schema import PERIODS

    return spark.createDataFrame([], PERIODS)


def config_anchors(accounts: DataFrame, openings: DataFrame, closings: DataFrame, opening_day: date | str) -> DataFrame:
    """Anchor rows the configuration asks for: one opening per account (null when unknown), one per closing."""
    day = as_day(opening_day)
    opened = accounts.join(openings.select(ACCOUNT, F.col("balance").alias("closing")), ACCOUNT, "left").select(
        ACCOUNT, F.trunc(day, "month").alias("period_start"), day.alias("period_end"), "closing",
        F.when(F.col("closing").isNotNull(), OPENING_SOURCE).alias("source"),
    )
    dated = closings.join(accounts.select(ACCOUNT), ACCOUNT).select(
        ACCOUNT, F.trunc("as_of", "month").alias("period_start"), F.col("as_of").alias("period_end"),
        F.col("balance").alias("closing"), F.lit(CLOSING_SOURCE).alias("source"),
    )
    return opened.unionByName(dated)


def seed_anchors(periods: DataFrame, anchors: DataFrame) -> DataFrame:
    """Merge configured anchors into the stored periods.

    A missing row is inserted, a null closing filled, a configured closing follows the
    configuration when it changed by a cent; evidence rows are never overwritten. The
    ``action`` column says which happened.
    """
    wanted = anchors.select(*PERIOD_KEY, F.col("closing").alias("_closing"), F.col("source").alias("_source"), F.lit(True).alias("_want"))
    both = periods.withColumn("_have", F.lit(True)).join(wanted, list(PERIOD_KEY), "full_outer")
    have, given = F.coalesce("_have", F.lit(False)), F.col("_closing").isNotNull()
    configured = F.col("closing_source").isin(OPENING_SOURCE, CLOSING_SOURCE)
    action = (
        F.when(~have, "insert")
        .when(given & F.col("statement_closing").isNull(), "fill")
        .when(given & configured & (S.cents("_closing") != S.cents("statement_closing")), "follow")
        .otherwise("keep")
    )
    both = both.withColumn("action", action)
    closing = F.when(F.col("action") == "keep", F.col("statement_closing")).otherwise(F.col("_closing"))
    source = F.when(F.col("action").isin("insert", "fill"), F.col("_source")).otherwise(F.col("closing_source"))
    return (
        both.withColumn("closing_source", source)
        .withColumn("statement_closing", closing.cast("decimal(18,2)"))
        .withColumn("variance_explanation", F.coalesce("variance_explanation", F.lit("")))
        .drop("_closing", "_source", "_want", "_have")
    )


def refresh_goals(goals: DataFrame, goal_accounts: DataFrame, balances: DataFrame) -> DataFrame:
    """Goal amounts follow the computed balance of their account; no anchor leaves the goal alone."""
    now = goal_accounts.join(balances.select(ACCOUNT, "computed_balance"), ACCOUNT).select("gate_key", "computed_balance")
    return (
        goals.join(now, "gate_key", "left")
        .withColumn("updated", F.col("computed_balance").isNotNull())
        .withColumn("current_amount", F.coalesce("computed_balance", "current_amount").cast("decimal(18,2)"))
        .drop("computed_balance")
    )


def prior_closing(periods: DataFrame, before: date | str) -> DataFrame:
    """Closing of the last stored period ending before a day: statement, else computed."""
    origin = F.lit("0001-01-01").cast("date")
    # days as one number keep the state of a group fixed in width, so it is hashed and not sorted
    order = F.datediff("period_end", origin).cast("long") * 10_000_000 + F.datediff("period_start", origin)
    return (
        periods.where(F.col("period_end") < as_day(before))
        .groupBy(ACCOUNT)
        .agg(F.max_by(F.coalesce("statement_closing", "computed_closing"), order).alias("prior_closing"))
    )


def _per_account(df: DataFrame, values: Column, name: str, tasks: int) -> DataFrame:
    """One row per account that holds ``values`` of its rows, dealt to ``tasks`` like the accounts of ``reconcile``."""
    return df.select(ACCOUNT, values.alias(name)).repartition(tasks, ACCOUNT).groupBy(ACCOUNT).agg(F.collect_list(name).alias(name))


def only_asked(periods: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """Periods whose ``column`` is among the days that ``asked(account_id, day)`` lists for their account.

    Periods are met by account alone, so those that are dealt by account are not dealt again.
    """
    days = asked.groupBy(ACCOUNT).agg(F.collect_set("day").alias("_asked"))
    return periods.join(days, ACCOUNT).where(F.array_contains("_asked", F.col(column))).drop("_asked")


def _parts_of(month: Column) -> Column:
    """The periods of a month: plain, or verify (ends at the checkpoint) and remainder (opens at it)."""
    start, end, day, held = month["period_start"], month["period_end"], month["g"]["as_of"], month["g"]["balance"]
    none = F.lit(None).cast("decimal(18,2)")

    def part(first: Column, last: Column, role: str, anchor: Column, fixed: Column) -> Column:
        return F.struct(
            first.alias("period_start"), last.alias("period_end"), F.lit(role).alias("role"), day.alias("governing_day"),
            anchor.cast("decimal(18,2)").alias("own_anchor"), fixed.cast("decimal(18,2)").alias("checkpoint_balance"),
        )

    return (
        F.when(day.isNull(), F.array(part(start, end, "plain", none, none)))
        .when(day >= end, F.array(part(start, end, "verify", none, held)))
        .when(day <= start, F.array(part(F.date_add(day, 1), end, "remainder", held, none)))
        .otherwise(F.array(part(start, day, "verify", none, held), part(F.date_add(day, 1), end, "remainder", held, none)))
    )


def _flows_between(start: Column, end: Column) -> Column:
    """Flows of the account's days from ``start`` to ``end`` in cents, as a struct."""
    none = F.struct(*[F.lit(0).cast("long").alias(f) for f in FLOWS])
    inside = F.filter("_days", lambda d: d["occurred_on"].between(start, end))
    add = lambda acc, d: F.struct(*[(acc[f] + d[f]).alias(f) for f in FLOWS])
    return F.coalesce(F.aggregate(inside, none, add), none)


def reconcile(
    ledger: DataFrame,
    accounts: DataFrame,
    openings: DataFrame,
    closings: DataFrame,
    stored: DataFrame,
    *,
    start: date | str,
    end: date | str,
    as_of: date | str,
    seed_day: date | str,
) -> DataFrame:
    """One row per account and period between ``start`` and ``end``.

    ``ledger`` carries ``running_balance`` (null where the export has none); ``openings``
    and ``closings`` are ``(account_id, balance)`` and ``(account_id, as_of, balance)``.
    The opening of a period is the prior statement closing, else the prior computed
    closing. An account's days, closings and notes meet in one row, which calendar days bound;
    its periods are computed there in order and unfold last, so none of them is shuffled or sorted.
    Accounts are counted first: a task gets a bounded number of them.
    """
    tasks = spread(accounts)
    days = day_breakdown(ledger, F.count("running_balance").alias("balances"))
    per_account = (
        days.repartition(tasks, ACCOUNT)
        .groupBy(ACCOUNT)
        .agg(
            F.max("occurred_on").alias("newest_row"), (F.sum("balances") > 0).alias("has_running_balance"),
            F.collect_list(F.struct("occurred_on", *[S.cents(f).alias(f) for f in FLOWS])).alias("_days"),
        )
    )
    chained = _per_account(day_closings(ledger), F.struct(F.col("occurred_on").alias("day"), "closing", "closing_source"), "_chains", tasks)
    marks = _per_account(closings, F.struct("as_of", F.col("balance").cast("decimal(18,2)").alias("balance")), "_marks", tasks)
    notes = _per_account(stored, F.struct("period_start", "period_end", F.col("variance_explanation").alias("note")), "_notes", tasks)

    seed_month = F.when(F.dayofmonth(as_day(seed_day)) == 1, as_day(seed_day)).otherwise(
        F.add_months(F.trunc(as_day(seed_day), "month"), 1)
    )
    first_month = F.trunc(as_day(start), "month")
    initial = F.when(F.col("seed").isNotNull() & (first_month <= seed_month), F.col("seed")).otherwise(F.coalesce("prior_closing", "seed"))
    base = (
        accounts.select(ACCOUNT, "account_type")
        .repartition(tasks, ACCOUNT)
        .join(per_account, ACCOUNT, "left")
        .join(chained, ACCOUNT, "left")
        .join(marks, ACCOUNT, "left")
        .join(notes, ACCOUNT, "left")
        .join(openings.select(ACCOUNT, F.col("balance").alias("seed")), ACCOUNT, "left")
        .join(prior_closing(stored, first_month), ACCOUNT, "left")
        .withColumn("has_running_balance", F.coalesce("has_running_balance", F.lit(False)))
        .withColumn("eligible", ~F.col("has_running_balance") & (F.col("account_type") != "credit_card"))
        .withColumn("initial_opening", initial.cast("decimal(18,2)"))
    )

    last_day = as_day(end)

    def month(m: Column) -> Column:
        until = F.least(F.last_day(m), last_day)
        mine = F.filter("_marks", lambda c: (F.trunc(c["as_of"], "month") == m) & (c["as_of"] <= until))
        return F.struct(m.alias("period_start"), until.alias("period_end"), F.when(F.col("eligible"), F.array_max(mine)).alias("g"))

    parts = F.flatten(F.transform(F.transform(_months_between(start, end), month), _parts_of))

    def filled(p: Column) -> Column:
        given = F.array_max(F.filter("_marks", lambda c: c["as_of"] == p["period_end"]))["balance"]
        active = F.array_max(F.transform(F.filter("_days", lambda d: d["occurred_on"] <= p["period_end"]), lambda d: d["occurred_on"]))
        chain = F.get(F.filter("_chains", lambda c: c["day"] == active), F.lit(0))
        note = F.array_max(F.filter("_notes", lambda n: (n["period_start"] == p["period_start"]) & (n["period_end"] == p["period_end"])))["note"]
        return F.struct(
            p.alias("p"), _flows_between(p["period_start"], p["period_end"]).alias("f"), given.alias("given"),
            F.when(F.col("has_running_balance"), chain).alias("chain"), note.alias("note"),
        )

    def closing_of(q: Column) -> Column:
        return F.coalesce(q["p"]["checkpoint_balance"], q["given"], q["chain"]["closing"]).cast("decimal(18,2)")

    def net_of(q: Column) -> Column:
        f = q["f"]
        net = f["inflows"] + f["transfers_in"] - f["outflows"] - f["transfers_out"]
        return F.when(F.col("account_type") == "credit_card", -net).otherwise(net)

    def opened(acc: Column, q: Column) -> Column:
        opening = F.coalesce(S.cents(q["p"]["own_anchor"]), acc["next"])
        computed = opening + net_of(q)
        return F.struct(F.concat(acc["all"], F.array(opening)).alias("all"), F.coalesce(S.cents(closing_of(q)), computed).alias("next"))

    at_first = F.struct(F.array().cast("array<long>").alias("all"), S.cents("initial_opening").alias("next"))
    rows = base.withColumn("_q", F.transform(parts, filled))
    rows = rows.withColumn("_o", F.aggregate("_q", at_first, opened)["all"])
    together = F.transform("_q", lambda q, i: F.struct(q.alias("q"), F.get("_o", i).alias("opening")))
    rows = rows.select(ACCOUNT, "account_type", "newest_row", F.explode(together).alias("_r")).select(
        ACCOUNT, "account_type", "newest_row", "_r.q.p.*", "_r.q.f.*", "_r.q.given", "_r.q.chain", F.col("_r.q.note").alias("_note"),
        _money(F.col("_r.opening")).alias("statement_opening"), _money(F.col("_r.opening") + net_of(F.col("_r.q"))).alias("computed_closing"),
        F.col("_r.q").alias("_q"),
    )
    rows = (
        rows.withColumn("statement_closing", closing_of(F.col("_q")))
        .withColumn("variance", (F.col("statement_closing") - F.col("computed_closing")).cast("decimal(18,2)"))
        .withColumn("closing_day", F.col("chain.day"))
        .withColumn(
            "closing_source",
            F.when(F.col("checkpoint_balance").isNotNull(), CHECKPOINT_SOURCE)
            .when(F.col("given").isNotNull(), CLOSING_SOURCE)
            .otherwise(F.col("chain.closing_source")),
        )
    )
    is_checkpoint = F.col("closing_source") == CHECKPOINT_SOURCE
    within_cent = F.coalesce(is_checkpoint & (F.abs("variance") <= 0.01), F.lit(False))
    rows = rows.withColumn("variance", F.when(within_cent, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("variance")))

    stale = F.when(
        is_checkpoint,
        (F.coalesce(F.col("newest_row") > F.col("governing_day"), F.lit(False)))
        | (F.datediff(as_day(as_of), F.col("governing_day")) > CHECKPOINT_STALE_DAYS),
    )
    return rows.select(
        *PERIOD_KEY,
        "account_type",
        "role",
        "statement_opening",
        "statement_closing",
        "closing_source",
        *[_money(F.col(f)).alias(f"computed_{f}") for f in FLOWS],
        "computed_closing",
        "variance",
        _explanation().alias("variance_explanation"),
        stale.alias("checkpoint_stale"),
    )


def _explanation() -> Column:
    """The human note with a fresh system line in front when there is something to say."""
    old = F.filter(F.split(F.coalesce("_note", F.lit("")), "\n"), lambda line: (F.trim(line) != "") & ~line.startswith(CHECKPOINT_NOTE))
    money = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    checkpoint = F.concat(
        F.lit(f"{CHECKPOINT_NOTE} "), F.col("period_end").cast("string"), F.lit(" balance "), money("statement_closing"),
        F.when(F.col("variance").isNull(), F.lit(" taken as anchor, no opening to verify"))
        .otherwise(F.concat(F.lit(" differs from the chain by "), money("variance"))),
    )
    unclear = F.concat(F.lit("Intraday order unclear on "), F.col("closing_day").cast("string"), F.lit("; highest balance used"))
    system = F.when(F.col("closing_source") == CHECKPOINT_SOURCE, checkpoint).when(
        F.col("closing_source") == "running_balance_unresolved", unclear
    )
    kept = F.filter(old, lambda line: F.coalesce(line != system, F.lit(True)))
    return F.concat_ws("\n", F.array_compact(F.concat(F.array(system), kept)))


def merge_periods(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored periods with the recomputed ones in place of equal keys.

    A full-month row whose month is now split is dropped, as its key no longer occurs.
    """
    columns = [f for f in stored.columns]
    split_months = fresh.where("role <> 'plain'").select(
        ACCOUNT, F.trunc("period_start", "month").alias("period_start"), F.last_day("period_start").alias("period_end")
    ).distinct()
    kept = stored.join(fresh.select(*PERIOD_KEY), list(PERIOD_KEY), "left_anti").join(split_months, list(PERIOD_KEY), "left_anti")
    return kept.unionByName(fresh.select(*columns))


def checkpoint_deltas(ledger: DataFrame, closings: DataFrame, periods: DataFrame) -> DataFrame:
    """Each checkpoint of a month against the one before it (the first against the month's opening).

    ``periods(account_id, period_start, statement_opening)`` gives the month openings.
    """
    daily = ledger.groupBy(ACCOUNT, "occurred_on").agg(F.sum(S.posted_effect()).alias("moved"))
    running = Window.partitionBy(ACCOUNT).orderBy("occurred_on").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = daily.select(ACCOUNT, "occurred_on", F.sum("moved").over(running).alias("total"))
    marks = closings.withColumn("month_start", F.trunc("as_of", "month"))
    ends = marks.select(ACCOUNT, F.col("as_of").alias("day")).unionByName(
        marks.select(ACCOUNT, F.date_sub("month_start", 1).alias("day"))
    )
    totals = as_of_values(ends, cumulative, [ACCOUNT], "day", "occurred_on", ["total"], fallback_first=False).select(
        ACCOUNT, "day", F.coalesce("total", zero()).alias("total")
    )
    asked = marks.select(ACCOUNT, F.col("month_start").alias("day"))
    opened = only_asked(periods.select(ACCOUNT, F.col("period_start").alias("month_start"), "statement_opening"), asked, "month_start")
    at_mark = totals.withColumnsRenamed({"day": "as_of", "total": "at_mark"})
    at_start = totals.select(ACCOUNT, F.add_months(F.trunc("day", "month"), 1).alias("month_start"), F.col("day").alias("_d"), F.col("total").alias("at_start"))
    at_start = at_start.where(F.col("_d") == F.date_sub("month_start", 1)).drop("_d")
    rows = marks.join(at_mark, [ACCOUNT, "as_of"]).join(at_start, [ACCOUNT, "month_start"]).join(opened, [ACCOUNT, "month_start"])
    within = Window.partitionBy(ACCOUNT, "month_start").orderBy("as_of")
    held = F.coalesce(F.lag("balance").over(within), F.col("statement_opening"))
    since = F.coalesce(F.lag("at_mark").over(within), F.col("at_start"))
    delta = F.col("balance") - held - (F.col("at_mark") - since)
    return rows.select(
        ACCOUNT, "as_of", "balance", delta.alias("_delta"), F.row_number().over(within).alias("position")
    ).select(
        ACCOUNT, "as_of", "balance", "position",
        F.when(F.abs("_delta") <= 0.01, zero()).otherwise(F.col("_delta")).cast("decimal(18,2)").alias("delta"),
    )


def checkpoint_staleness(ledger: DataFrame, closings: DataFrame, as_of: date | str) -> DataFrame:
    """Whether each account's newest checkpoint is out of date: newer rows exist, or it is old."""
    newest = closings.groupBy(ACCOUNT).agg(F.max("as_of").alias("checkpoint_day"))
    last = ledger.groupBy(ACCOUNT).agg(F.max("occurred_on").alias("newest_row"))
    age = F.datediff(as_day(as_of), F.col("checkpoint_day"))
    newer = F.coalesce(F.col("newest_row") > F.col("checkpoint_day"), F.lit(False))
    return newest.join(last, ACCOUNT, "left").select(
        ACCOUNT, "checkpoint_day", "newest_row", age.alias("age_days"), (newer | (age > CHECKPOINT_STALE_DAYS)).alias("stale")
    )


def upsert_checkpoint(closings: DataFrame, entry: DataFrame, accounts: DataFrame) -> DataFrame:
    """Closings with ``entry(account_id, as_of, balance)`` added or replaced; cards are refused."""
    cash = accounts.where(F.col("account_type") != "credit_card").select(ACCOUNT)
    accepted = entry.join(cash, ACCOUNT, "left_semi").select(ACCOUNT, "as_of", "balance")
    kept = closings.select(ACCOUNT, "as_of", "balance").join(accepted, [ACCOUNT, "as_of"], "left_anti")
    return kept.unionByName(accepted)


def checkpoint_result(reconciled: DataFrame, entry: DataFrame) -> DataFrame:
    """For each written checkpoint: its own period and the period that opens after it."""
    ordered = Window.partitionBy(ACCOUNT).orderBy("period_start")
    following = reconciled.withColumn("next_opening", F.lead("statement_opening").over(ordered))
    return entry.select(ACCOUNT, F.col("as_of").alias("period_end")).join(
        only_asked(
            following.select(*PERIOD_KEY, "statement_closing", "computed_closing", "variance", "next_opening", "checkpoint_stale"),
            entry.select(ACCOUNT, F.col("as_of").alias("day")), "period_end",
        ),
        [ACCOUNT, "period_end"],
        "left",
    )


def save_explanations(periods: DataFrame, notes: DataFrame) -> DataFrame:
    """Human notes ``(account_id, period_start, period_end, explanation)`` written onto their periods."""
    found = notes.groupBy(ACCOUNT).agg(F.collect_list(F.struct("period_start", "period_end", "explanation")).alias("_new"))
    mine = F.filter("_new", lambda n: (n["period_start"] == F.col("period_start")) & (n["period_end"] == F.col("period_end")))
    return (
        periods.join(found, ACCOUNT, "left")
        .withColumn("variance_explanation", F.coalesce(F.array_max(mine)["explanation"], "variance_explanation"))
        .drop("_new")
    )


def latest_and_history(periods: DataFrame) -> DataFrame:
    """Periods numbered from the newest per account; 1 is the current one, the rest are history."""
    newest = Window.partitionBy(ACCOUNT).orderBy(F.col("period_end").desc(), F.col("period_start").desc())
    return periods.withColumn("recency", F.row_number().over(newest))


def goal_progress(periods: DataFrame, accounts: DataFrame, goals: DataFrame) -> DataFrame:
    """Goal amount from the newest savings closing of the household, with progress capped at one."""
    closing = F.coalesce("statement_closing", "computed_closing")
    newest = (
        periods.withColumn("closing", closing)
        .where(F.col("closing").isNotNull())
        .join(accounts.where(F.col("account_type") == "savings").select(ACCOUNT, "household_id"), ACCOUNT)
        .groupBy("household_id")
        .agg(F.max(F.struct("period_end", ACCOUNT, "closing"))["closing"].alias("closing"))
    )
    ratio = F.col("current_amount").cast("double") / F.col("target_amount").cast("double")
    return (
        goals.join(newest, "household_id", "left")
        .withColumn("current_amount", F.coalesce("closing", "current_amount"))
        .withColumn("progress", F.when(F.col("target_amount") == 0, 0.0).otherwise(F.least(ratio, F.lit(1.0))))
        .withColumn("complete", F.coalesce((F.col("target_amount") != 0) & (ratio >= 1), F.lit(False)))
        .drop("closing")
    )


def trajectory(periods: DataFrame, accounts: DataFrame, kinds: Sequence[str] = ("savings",)) -> DataFrame:
    """Balance points ``(account_id, day, balance)`` of savings accounts, one per reconciled period."""
    wanted = accounts.where(F.col("account_type").isin(*kinds)).select(ACCOUNT)
    return (
        periods.join(wanted, ACCOUNT)
        .select(ACCOUNT, F.col("period_end").alias("day"), F.coalesce("statement_closing", "computed_closing").alias("balance"))
        .where(F.col("balance").isNotNull())
    )

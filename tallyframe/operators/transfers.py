"""Transfer pairing without pair enumeration.

Rows of one household, amount, account, day and sign are interchangeable when partners
are sought, so the search runs over such *cells*. Per amount there are at most two cell
totals per day; a window over the days of an amount finds the nearest opposite-sign day
on another account. Work per cell is bounded by the tolerance, whatever the number of
rows behind one amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators.ranges import number_in_group
from tallyframe.session import cut_lineage

AMOUNT_KEY = ("household_id", "cents")
CELL = ("household_id", "cents", "account_id", "day", "sign")
TOLERANCE_DAYS = 5

# Descriptions that mark a likely untagged transfer leg.
STRONG_PATTERNS = (r"fid\s*bkg\s*svc\s*llc\s*moneyline", r"venmo\s*payment", r"mobile\s*check\s*dep")
# Fixed value: inbound legs that fall back to inflow when no partner exists.
INBOUND_PATTERNS = (r"requested\s+transfer\s+from",)
INBOUND_ACCOUNTS = ("acct-ally-hysa",)


def inbound_domain(accounts: tuple[str, ...] = INBOUND_ACCOUNTS, patterns: tuple[str, ...] = INBOUND_PATTERNS) -> Column:
    """Rows the unpaired-inbound reclassification owns, in both directions."""
    return F.col("account_id").isin(*accounts) & S.any_pattern("description_raw", patterns)


def rearm(ledger: DataFrame, domain: Column) -> DataFrame:
    """Unpaired inbound rows that an earlier run turned into inflows become transfers again."""
    again = (
        (F.col("direction") == "inflow")
        & F.col("transfer_group_key").isNull()
        & (F.col("primary_category") == "transfer")
        & domain
    )
    return ledger.withColumn("rearmed", F.coalesce(again, F.lit(False))).withColumn(
        "direction", F.when(F.col("rearmed"), "transfer").otherwise(F.col("direction"))
    )


def candidates(ledger: DataFrame) -> DataFrame:
    """Unpaired rows with transfer direction and transfer category, with their cell keys."""
    wanted = (
        F.col("transfer_group_key").isNull() & (F.col("direction") == "transfer") & (F.col("primary_category") == "transfer")
    )
    return ledger.where(wanted).select(
        "household_id",
        "id",
        "account_id",
        F.abs(S.cents("amount")).alias("cents"),
        F.col("occurred_on").alias("day"),
        F.signum("amount").cast("int").alias("sign"),
    )


def _near(columns: tuple[str, ...], keys: tuple[str, ...], tolerance: int) -> Column:
    days = F.unix_date("day").cast("bigint")
    window = Window.partitionBy(*keys).orderBy(days).rangeBetween(-tolerance, tolerance)
    return F.collect_list(F.struct(*columns)).over(window)


def partner_cells(rows: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """For every cell: how many best partners its rows have, on which days, and who they are if unique.

    Best partners are the opposite-sign rows of other accounts at the smallest day distance
    within the tolerance. ``only_account`` is set when all of them sit on one account.
    """
    cells = rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.min("id").alias("one_id"))
    who = F.struct("account_id", "one_id")
    totals = cells.groupBy(*AMOUNT_KEY, "day", "sign").agg(
        F.sum("n").alias("n"), F.count("*").alias("accounts"), F.min(who).alias("low"), F.max(who).alias("high")
    )
    totals = totals.select(
        *AMOUNT_KEY, "day", "sign",
        _near(("day", "sign", "n", "accounts", "low", "high"), AMOUNT_KEY, tolerance).alias("near"),
        F.sum("n").over(Window.partitionBy(*AMOUNT_KEY)).alias("amount_rows"),
    )
    own = cells.withColumn("own", _near(("day", "sign", "n"), (*AMOUNT_KEY, "account_id"), tolerance))
    joined = own.join(totals, [*AMOUNT_KEY, "day", "sign"])

    def mine(offer: Column) -> Column:
        same = F.filter("own", lambda o: (o["day"] == offer["day"]) & (o["sign"] == offer["sign"]))
        return F.coalesce(F.get(same, F.lit(0))["n"], F.lit(0))

    def offer(x: Column) -> Column:
        left = x["n"] - mine(x)
        others = x["accounts"] - F.when(mine(x) > 0, 1).otherwise(0)
        other = F.when(x["low"]["account_id"] != F.col("account_id"), x["low"]).otherwise(x["high"])
        return F.struct(
            F.abs(F.datediff(x["day"], F.col("day"))).alias("gap"), x["day"].alias("day"), left.alias("n"),
            others.alias("accounts"), other["account_id"].alias("account_id"), other["one_id"].alias("one_id"),
        )

    offers = F.filter(
        F.transform(F.filter("near", lambda x: (x["sign"] == -F.col("sign")) & (F.col("sign") != 0)), offer), lambda o: o["n"] > 0
    )
    found = joined.withColumn("offers", offers).withColumn("gap", F.array_min(F.transform("offers", lambda o: o["gap"])))
    found = found.withColumn("best", F.filter("offers", lambda o: o["gap"] == F.col("gap")))
    partners = F.aggregate("best", F.lit(0).cast("bigint"), lambda acc, o: acc + o["n"])
    named = F.array_distinct(F.transform("best", lambda o: F.when(o["accounts"] == 1, o["account_id"]).otherwise(F.lit(""))))
    one = F.get("best", F.lit(0))
    own_rows = F.aggregate("own", F.lit(0).cast("bigint"), lambda acc, o: acc + o["n"])
    return found.withColumn("partners", partners).select(
        *CELL,
        "n",
        "one_id",
        "gap",
        "partners",
        F.array_sort(F.transform("best", lambda o: o["day"])).alias("best_days"),
        F.when((F.size(named) == 1) & (F.get(named, F.lit(0)) != ""), F.get(named, F.lit(0))).alias("only_account"),
        F.when(F.col("partners") == 1, one["one_id"]).alias("partner_id"),
        (own_rows - 1).alias("same_account_hits"),
        F.col("amount_rows"),
    )


def _singles(cells: DataFrame) -> DataFrame:
    """Cells whose rows have exactly one best partner, with that partner's own view."""
    one = cells.where("partners = 1").select(
        *CELL, "n", "one_id", "partner_id", F.col("only_account").alias("p_account"), F.get("best_days", F.lit(0)).alias("p_day")
    )
    view = one.select(
        "household_id", "cents", F.col("account_id").alias("p_account"), F.col("day").alias("p_day"), (-F.col("sign")).alias("sign"),
        F.col("partner_id").alias("p_partner_id"), F.col("p_day").alias("q_day"), F.col("one_id").alias("p_one_id"),
    )
    return one.join(view, ["household_id", "cents", "p_account", "p_day", "sign"], "left")


def _mutual() -> Column:
    return F.coalesce((F.col("n") == 1) & (F.col("p_partner_id") == F.col("one_id")), F.lit(False))


def _first_leg_is(row_day: str, row_id: str, other_day: str, other_id: str) -> Column:
    return F.struct(F.col(row_day).alias("d"), F.col(row_id).alias("i")) < F.struct(F.col(other_day).alias("d"), F.col(other_id).alias("i"))


def mutual_pairs(cells: DataFrame) -> DataFrame:
    """Pairs in which each row is the other's only best partner; ``left`` is the earlier leg."""
    both = _singles(cells).where(_mutual() & _first_leg_is("day", "one_id", "p_day", "partner_id"))
    return both.select(
        *AMOUNT_KEY, F.col("one_id").alias("left_id"), F.col("partner_id").alias("right_id"),
        F.col("account_id").alias("left_account"), F.col("p_account").alias("right_account"),
        F.col("day").alias("left_day"), F.col("p_day").alias("right_day"), F.lit("mutual").alias("kind"),
    )


def balanced_groups(cells: DataFrame) -> DataFrame:
    """Ambiguous cells that form an N-to-N group of exactly two accounts.

    A side is the cells of one account and sign that share their best partners. Two sides
    group when each one's members are the other's best partners, they hold equally many
    rows, and no further ambiguous cell counts any of them among its best partners.
    Returns the cells with ``group_id`` and ``side``.
    """
    unclear = cells.where("partners > 1")
    sides = (
        unclear.where(F.col("only_account").isNotNull())
        .groupBy("household_id", "cents", "account_id", "sign", "only_account", "best_days")
        .agg(F.array_sort(F.collect_set("day")).alias("members"), F.sum("n").alias("rows"))
    )
    other = sides.select(
        "household_id", "cents", F.col("account_id").alias("only_account"), F.col("only_account").alias("account_id"),
        (-F.col("sign")).alias("sign"), F.col("members").alias("best_days"), F.col("best_days").alias("members"), F.col("rows"),
    )
    keys = ["household_id", "cents", "account_id", "sign", "only_account", "best_days", "members", "rows"]
    matched = sides.join(other, keys, "left_semi")

    # Every ambiguous cell votes for the days it points at; its own account's rows there are not meant.
    votes = unclear.select(
        "household_id", "cents", "account_id", (-F.col("sign")).alias("sign"), F.explode("best_days").alias("day")
    )
    everyone = votes.groupBy("household_id", "cents", "sign", "day").agg(F.count("*").alias("votes"))
    own = votes.groupBy("household_id", "cents", "sign", "day", "account_id").agg(F.count("*").alias("own_votes"))
    member = matched.select("*", F.explode("members").alias("day"))
    checked = member.join(everyone, ["household_id", "cents", "sign", "day"], "left").join(
        own, ["household_id", "cents", "sign", "day", "account_id"], "left"
    )
    outside = F.coalesce("votes", F.lit(0)) - F.coalesce("own_votes", F.lit(0)) - F.size("best_days")
    closed = (
        checked.groupBy("household_id", "cents", "account_id", "sign", "only_account", "best_days", "members")
        .agg(F.max(outside).alias("outside"))
        .where("outside = 0")
    )
    plus = F.col("sign") > 0
    lead = F.when(plus, F.col("account_id")).otherwise(F.col("only_account"))
    trail = F.when(plus, F.col("only_account")).otherwise(F.col("account_id"))
    lead_days = F.when(plus, F.col("members")).otherwise(F.col("best_days"))
    group = S.digest(24, F.col("household_id"), F.col("cents"), lead, trail, F.array_join(lead_days.cast("array<string>"), ","))
    named = closed.withColumn("group_id", group)
    whole = named.groupBy("group_id").agg(F.count("*").alias("sides")).where("sides = 2").select("group_id")
    return named.join(whole, "group_id").select(
        "group_id", "household_id", "cents", "account_id", "sign", F.explode("members").alias("day")
    )


def group_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of balanced groups zipped one to one in id order."""
    members = rows.join(groups, list(CELL))
    ranked = number_in_group(members, ["group_id", "account_id"], ["id"])
    sides = ranked.groupBy("group_id", "household_id", "cents", "rank").agg(
        F.min(F.struct("account_id", "id", "day")).alias("a"), F.max(F.struct("account_id", "id", "day")).alias("b")
    )
    return sides.select(
        *AMOUNT_KEY, F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"),
        F.col("a.account_id").alias("left_account"), F.col("b.account_id").alias("right_account"),
        F.col("a.day").alias("left_day"), F.col("b.day").alias("right_day"), F.lit("group").alias("kind"),
    )


def group_key() -> Column:
    """The same key on every run: a digest of the two ids in order."""
    return S.digest(32, F.least("left_id", "right_id"), F.greatest("left_id", "right_id"))


def pairs_of(rows: DataFrame, cells: DataFrame) -> DataFrame:
    both = mutual_pairs(cells).unionByName(group_pairs(rows, balanced_groups(cells)))
    return both.withColumn("transfer_group_key", group_key())


def settled_cells(rows: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Partner cells written once: pairing, grouping and reporting all read them."""
    return cut_lineage(partner_cells(rows, tolerance))


def pair_transfers(ledger: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """All pairs of a ledger: mutual best partners, then balanced groups."""
    rows = candidates(ledger)
    return pairs_of(rows, settled_cells(rows, tolerance))


NO_CANDIDATE = "no candidate within the date tolerance"
NO_OTHER_ACCOUNT = "no candidate on another account within the date tolerance"
TAKEN = "preferred partner already paired with a closer match"
PREFERS_OTHER = "partner had a closer or ambiguous match elsewhere"


def candidate_status(rows: DataFrame, cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every candidate as paired, ambiguous or unpaired, with a reason and its candidate count."""
    pair = _singles(cells).select(*CELL, "partner_id", _mutual().alias("mutual"), "p_day", "p_partner_id", "q_day", "p_account")
    legs = mutual_pairs(cells).select(
        F.explode(F.array("left_id", "right_id")).alias("partner_id"),
        F.least(F.struct(F.col("left_day").alias("d"), F.col("left_id").alias("i")), F.struct(F.col("right_day").alias("d"), F.col("right_id").alias("i"))).alias("settled_at"),
    )
    cell_view = cells.select(*CELL, "partners", "same_account_hits", "amount_rows", "best_days").join(
        pair.select(*CELL, "partner_id").join(legs, "partner_id", "left"), list(CELL), "left"
    )
    settled = pairs.select(F.explode(F.array("left_id", "right_id")).alias("id"), "transfer_group_key")
    joined = rows.join(cell_view, list(CELL)).join(settled, "id", "left")
    me = F.struct(F.col("day").alias("d"), F.col("id").alias("i"))
    ambiguous = (F.col("partners") > 1) | ((F.col("partners") == 0) & (F.col("same_account_hits") > 0))
    status = F.when(F.col("transfer_group_key").isNotNull(), "paired").when(ambiguous, "ambiguous").otherwise("unpaired")
    reason = F.when(
        F.col("status") == "unpaired",
        F.when((F.col("partners") == 0) & (F.col("amount_rows") <= 1), NO_CANDIDATE)
        .when(F.col("partners") == 0, NO_OTHER_ACCOUNT)
        .when(F.coalesce(F.col("settled_at") < me, F.lit(False)), TAKEN)
        .otherwise(PREFERS_OTHER),
    )
    count = F.when(F.col("partners") > 0, F.col("partners")).otherwise(F.col("same_account_hits"))
    return joined.withColumn("status", status).select(
        "household_id", "id", "account_id", F.col("day").alias("occurred_on"), "cents", "sign", "status",
        reason.alias("reason"), count.alias("candidate_count"), "best_days", "transfer_group_key",
    )


def apply_pairing(ledger: DataFrame, tolerance: int = TOLERANCE_DAYS, domain: Column | None = None) -> DataFrame:
    """One full run: re-arm, pair, key both legs, turn unpaired inbound rows back into inflows."""
    owned = inbound_domain() if domain is None else domain
    armed = rearm(ledger, owned)
    rows = candidates(armed)
    cells = settled_cells(rows, tolerance)
    status = candidate_status(rows, cells, cut_lineage(pairs_of(rows, cells))).select(
        "id", F.col("status").alias("_status"), F.col("transfer_group_key").alias("_key")
    )
    joined = armed.join(status, "id", "left")
    fallen = F.coalesce((F.col("_status") == "unpaired") & owned, F.lit(False))
    return joined.withColumns(
        {
            "direction": F.when(fallen, "inflow").otherwise(F.col("direction")),
            "transfer_group_key": F.coalesce("transfer_group_key", "_key"),
            "reclassified": fallen,
        }
    ).select(*ledger.columns, "rearmed", "reclassified", F.col("_status").alias("pairing_status"))


def run_counts(applied: DataFrame) -> DataFrame:
    """Counts of one run from the output of ``apply_pairing`` (a dry run simply writes nothing)."""
    status = F.col("pairing_status")
    return applied.groupBy("household_id").agg(
        (F.count_if(status == "paired") / 2).cast("bigint").alias("pairs_created"),
        F.count_if(status.isNotNull()).alias("candidates_examined"),
        F.count_if(status.isNull() & F.col("transfer_group_key").isNotNull()).alias("already_paired"),
        F.count_if((status == "unpaired") & ~F.col("reclassified")).alias("unpaired"),
        F.count_if(status == "ambiguous").alias("ambiguous"),
        F.count_if("reclassified").alias("inbound_reclassified"),
        F.count_if("rearmed").alias("inbound_rearmed"),
        F.count_if(F.col("rearmed") & ~F.col("reclassified")).alias("inbound_rearmed_paired"),
    )


def suspected_untagged(ledger: DataFrame, pairs: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Non-transfer rows of a paired amount, near a leg, on a third account; the first leg is named.

    Legs are ordered by pair (mutual ones first, then by day and id), left before right. Per
    amount and day only three legs can ever be first for some account: the first one, and the
    first ones avoiding either of its two accounts.
    """
    sides = F.array(
        F.struct(F.lit(0).alias("leg"), F.col("left_id").alias("leg_id"), F.col("left_day").alias("leg_day")),
        F.struct(F.lit(1).alias("leg"), F.col("right_id").alias("leg_id"), F.col("right_day").alias("leg_day")),
    )
    place = F.struct(
        F.when(F.col("kind") == "mutual", 0).otherwise(1).alias("k"), F.col("left_day").alias("d"), F.col("left_id").alias("i"),
        F.col("s.leg").alias("l"), F.col("s.leg_id").alias("leg_id"), F.col("left_account").alias("a"), F.col("right_account").alias("b"),
    )
    # settled, as the first legs are found in them and then joined to them
    legs = cut_lineage(pairs.select("*", F.explode(sides).alias("s")).select(*AMOUNT_KEY, F.col("s.leg_day").alias("leg_day"), place.alias("p")))
    per_day = [*AMOUNT_KEY, "leg_day"]
    first = legs.groupBy(*per_day).agg(F.min("p").alias("f"))
    beside = legs.join(first, per_day)

    def avoids(account: Column) -> Column:
        return (F.col("p.a") != account) & (F.col("p.b") != account)

    kept = beside.groupBy(*per_day).agg(
        F.min("p").alias("p1"),
        F.min(F.when(avoids(F.col("f.a")), F.col("p"))).alias("p2"),
        F.min(F.when(avoids(F.col("f.b")), F.col("p"))).alias("p3"),
    )
    reach = F.transform(F.sequence(F.lit(-tolerance), F.lit(tolerance)), lambda o: F.date_add(F.col("leg_day"), o))
    near = (
        kept.select(*AMOUNT_KEY, F.explode(reach).alias("occurred_on"), F.array_compact(F.array("p1", "p2", "p3")).alias("ps"))
        .groupBy(*AMOUNT_KEY, "occurred_on")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("legs"))
    )
    plain = ledger.where(F.col("direction") != "transfer").select(
        "household_id", F.abs(S.cents("amount")).alias("cents"), "occurred_on", "id", "account_id", "description_raw"
    )
    fitting = F.filter("legs", lambda p: (p["a"] != F.col("account_id")) & (p["b"] != F.col("account_id")))
    found = plain.join(near, [*AMOUNT_KEY, "occurred_on"]).withColumn("leg", F.get(fitting, F.lit(0)))
    return found.where(F.col("leg").isNotNull()).select(
        "household_id", "id", "account_id", "occurred_on", "cents", F.col("leg.leg_id").alias("likely_partner_id"),
        F.when(S.any_pattern("description_raw", STRONG_PATTERNS), "strong").otherwise("weak").alias("confidence"),
    )


def unpaired_clusters(ledger: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Runs of unpaired transfer rows of one amount, chained while gaps stay within the tolerance.

    The gap test needs days only, so rows are first summed per amount, day and account.
    """
    per_account = (
        ledger.where((F.col("primary_category") == "transfer") & F.col("transfer_group_key").isNull())
        .withColumn("cents", F.abs(S.cents("amount")))
        .groupBy(*AMOUNT_KEY, "occurred_on", "account_id")
        .agg(F.count("*").alias("n"), F.sum(S.cents("amount")).alias("net"))
    )
    days = per_account.groupBy(*AMOUNT_KEY, "occurred_on").agg(
        F.sum("n").alias("n"), F.sum("net").alias("net"), F.min("account_id").alias("lo"), F.max("account_id").alias("hi")
    )
    in_order = Window.partitionBy(*AMOUNT_KEY).orderBy("occurred_on")
    breaks = F.when(F.datediff("occurred_on", F.lag("occurred_on").over(in_order)) > tolerance, 1).otherwise(0)
    numbered = days.withColumn("brk", breaks).withColumn(
        "run", F.sum("brk").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = numbered.groupBy(*AMOUNT_KEY, "run").agg(
        F.sum("n").alias("legs"), F.sum("net").alias("net"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("occurred_on").alias("first_on"), F.max("occurred_on").alias("last_on"),
    )
    return runs.withColumn("balanced", (F.col("legs") >= 2) & (F.col("lo") != F.col("hi")) & (F.col("net") == 0))


def balanced_clusters(ledger: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    return unpaired_clusters(ledger, tolerance).where("balanced").select(*AMOUNT_KEY, "first_on", "last_on", "legs")


def unpaired_rows(ledger: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Unpaired transfer rows, each told whether a balanced cluster explains it.

    Runs of one amount do not overlap, so a row finds its run by the latest start on or before its day.
    """
    runs = unpaired_clusters(ledger, tolerance).where("balanced")
    days = runs.select(*AMOUNT_KEY, F.explode(F.sequence("first_on", "last_on")).alias("occurred_on"), F.lit(True).alias("_in"))
    rows = ledger.where((F.col("primary_category") == "transfer") & F.col("transfer_group_key").isNull()).withColumn(
        "cents", F.abs(S.cents("amount"))
    )
    return rows.join(days, [*AMOUNT_KEY, "occurred_on"], "left").withColumn(
        "in_cluster", F.coalesce("_in", F.lit(False))
    ).drop("_in")

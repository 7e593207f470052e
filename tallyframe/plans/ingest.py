"""Ingest and month close: parsed statements to a classified, paired ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import overrides as O
from tallyframe.operators import rules as R
from tallyframe.operators import transfers
from tallyframe.operators.maintenance import reset_groups
from tallyframe.schema import LEDGER
from tallyframe.sources import layouts, store


def ledger_rows(parsed: DataFrame, batch_id: Column) -> DataFrame:
    """Parsed statement rows in ledger shape; one row per record key."""
    rows = layouts.parsed_rows(parsed).withColumn("import_batch_id", batch_id)
    return store.newest_batch(rows.select(*LEDGER.fieldNames()))


# A change reaches a pair of the rows it touches, their partners and the partners' partners.
REACH_DAYS = 3 * transfers.TOLERANCE_DAYS


def close(
    ledger: DataFrame,
    batch: DataFrame,
    rules: R.Rules,
    overrides: DataFrame,
    *,
    domain: Column | None = None,
    active: Column | None = None,
) -> DataFrame:
    """Upsert, overrides, classification and pairing as one plan.

    An update resets a row's category and transfer group, so all three always follow it.
    ``active`` limits pairing changes to rows whose surroundings are all in ``ledger``.
    """
    merged = store.upsert(ledger, O.apply_overrides(batch, overrides))
    freed = reset_groups(merged, within=active)
    classified = R.classify(freed, rules, overrides)
    held = classified.withColumns({"_direction": F.col("direction"), "_group": F.col("transfer_group_key")})
    paired = transfers.apply_pairing(held, domain=domain)
    if active is not None:
        paired = paired.withColumns(
            {
                "direction": F.when(active, F.col("direction")).otherwise(F.col("_direction")),
                "transfer_group_key": F.when(active, F.col("transfer_group_key")).otherwise(F.col("_group")),
            }
        )
    return paired.select(*ledger.columns)


def ingest_into(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    rules: R.Rules,
    overrides: DataFrame,
    *,
    domain: Column | None = None,
) -> None:
    """Close a batch into the stored ledger, reading and rewriting only the months around it.

    Each touched month is read with one on either side, as pairs straddle month ends; rows
    further from the batch than a change can reach keep their pairing.
    """
    months = store.touched_months(batch)
    if not months:
        return
    around = store.with_neighbours(months)
    active = F.lit(False)
    for first, last in _runs(months):
        start, end = F.lit(f"{first}-01").cast("date"), F.last_day(F.lit(f"{last}-01").cast("date"))
        active = active | F.col("occurred_on").between(F.date_sub(start, REACH_DAYS), F.date_add(end, REACH_DAYS))
    closed = close(store.read_ledger(spark, path, around), batch, rules, overrides, domain=domain, active=active)
    store.write_months(closed, path, around)


def _runs(months: Sequence[str]) -> list[tuple[str, str]]:
    """Sorted months as first and last of each run without a gap."""
    runs: list[tuple[str, str]] = []
    for month in months:
        if runs and month in store.with_neighbours([runs[-1][1]]):
            runs[-1] = (runs[-1][0], month)
        else:
            runs.append((month, month))
    return runs

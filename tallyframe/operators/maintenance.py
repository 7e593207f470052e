"""Ledger maintenance: removing a superseded batch, key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import rules as R
from tallyframe.operators import transfers


def remove_batch(ledger: DataFrame, *, batch: str | None = None, document: str | None = None) -> DataFrame:
    """The ledger without the rows of one import batch or document."""
    gone = F.lit(False)
    if batch is not None:
        gone = gone | F.col("import_batch_id").eqNullSafe(F.lit(batch))
    if document is not None:
        gone = gone | F.col("source_document_name").eqNullSafe(F.lit(document))
    return ledger.where(~gone)


def reset_groups(ledger: DataFrame, accounts: Sequence[str] = (), within: Column | None = None) -> DataFrame:
    """Clear the transfer group of rows whose group lost a leg or touches one of ``accounts``.

    ``within`` spares groups with a leg outside it, whose other leg may not be in ``ledger``.
    """
    touched = F.col("account_id").isin(*accounts) if accounts else F.lit(False)
    inside = F.lit(True) if within is None else within
    groups = ledger.where(F.col("transfer_group_key").isNotNull()).groupBy("transfer_group_key").agg(
        F.count("*").alias("_legs"), F.max(touched).alias("_touched"), F.min(inside).alias("_inside")
    )
    broken = groups.where(F.col("_inside") & ((F.col("_legs") < 2) | F.col("_touched"))).select("transfer_group_key", F.lit(True).alias("_broken"))
    return (
        ledger.join(broken, "transfer_group_key", "left")
        .withColumn("transfer_group_key", F.when(F.col("_broken").isNull(), F.col("transfer_group_key")))
        .select(*ledger.columns)
    )


def remediate(
    ledger: DataFrame,
    rules: R.Rules,
    overrides: DataFrame,
    *,
    batch: str | None = None,
    document: str | None = None,
    accounts: Sequence[str] = (),
    domain=None,
) -> DataFrame:
    """Remove a superseded batch, free its transfer groups, pair again, classify again."""
    reset = reset_groups(remove_batch(ledger, batch=batch, document=document), accounts)
    paired = transfers.apply_pairing(reset, domain=domain).select(*ledger.columns)
    return R.classify(paired, rules, overrides)


def key_collisions(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that more than one row carries."""
    return ledger.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

"""Manual overrides: durable corrections keyed by account, day, amount and description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.schema import OVERRIDABLE

TUPLE = ("account_id", "occurred_on", "amount", "description_raw")
FLAG = "manual_override_applied"
NOTE = "manual_override_note"


def apply_overrides(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Non-null override fields win on every row with the same match key; the row is flagged.

    Serves both the ingest path and a full re-application: it is idempotent.
    """
    fields = [F.col(f).alias(f"_o_{f}") for f in OVERRIDABLE]
    stored = overrides.select(F.col("match_key").alias("_key"), F.col("note").alias("_note"), F.lit(True).alias("_hit"), *fields)
    joined = ledger.withColumn("_key", S.override_key()).join(stored, "_key", "left")
    note = F.when(F.col("_note") != "", F.col("_note"))
    merged = S.merge_metadata("metadata", {FLAG: F.lit("true"), NOTE: note})
    changed = {f: F.coalesce(F.col(f"_o_{f}"), F.col(f)) for f in OVERRIDABLE}
    changed["metadata"] = F.when(F.col("_hit"), merged).otherwise(F.col("metadata"))
    return joined.withColumns(changed).select(*ledger.columns)


def override_requests(rows: DataFrame, **values: Column | str | None) -> DataFrame:
    """One override request per ledger row, with the given field values (absent fields stay null)."""
    unknown = set(values) - {*OVERRIDABLE, "note", "seq"}
    if unknown:
        raise ValueError(f"not overridable: {sorted(unknown)}")

    def value(name: str, default: Column) -> Column:
        given = values.get(name)
        if given is None:
            return default
        return given if isinstance(given, Column) else F.lit(given)

    none = F.lit(None).cast("string")
    return rows.select(
        S.override_key().alias("match_key"),
        *TUPLE,
        *[value(f, none).alias(f) for f in OVERRIDABLE],
        value("note", F.lit("")).alias("note"),
        value("seq", F.lit(0)).cast("bigint").alias("seq"),
    )


def upsert_overrides(overrides: DataFrame, requests: DataFrame) -> DataFrame:
    """Merge requests into the stored overrides: the newest non-null value per field wins.

    An empty request note keeps the stored one. ``seq`` orders requests for one key.
    """

    def newest(name: str, present: Column) -> Column:
        return F.max_by(F.col(name), F.when(present, F.col("seq"))).alias(name)

    merged = requests.groupBy("match_key").agg(
        *[F.first(c).alias(c) for c in TUPLE],
        *[newest(f, F.col(f).isNotNull()) for f in OVERRIDABLE],
        newest("note", F.coalesce(F.col("note") != "", F.lit(False))),
    )
    new = merged.select("match_key", *[F.col(c).alias(f"_n_{c}") for c in (*TUPLE, *OVERRIDABLE, "note")])
    both = overrides.select("match_key", *TUPLE, *OVERRIDABLE, "note").join(new, "match_key", "full_outer")
    return both.select(
        "match_key",
        *[F.coalesce(F.col(c), F.col(f"_n_{c}")).alias(c) for c in TUPLE],
        *[F.coalesce(F.col(f"_n_{f}"), F.col(f)).alias(f) for f in OVERRIDABLE],
        F.coalesce(F.col("_n_note"), F.col("note"), F.lit("")).alias("note"),
    )


def stamp_flags(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Flag rows whose (account, day, amount, description) tuple carries an override."""
    governed = overrides.select(*TUPLE).distinct().withColumn("_hit", F.lit(True))
    flagged = S.merge_metadata("metadata", {FLAG: F.lit("true")})
    return (
        ledger.join(governed, list(TUPLE), "left")
        .withColumn("metadata", F.when(F.col("_hit"), flagged).otherwise(F.col("metadata")))
        .select(*ledger.columns)
    )


def governed_rows(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    return ledger.join(overrides.select(*TUPLE), list(TUPLE), "left_semi")


def orphaned_overrides(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides whose tuple matches no row."""
    return overrides.join(ledger.select(*TUPLE), list(TUPLE), "left_anti")


def override_effect(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each governed row with the fields that differ from its override and whether it is flagged."""
    wanted = overrides.select(*TUPLE, "match_key", *[F.col(f).alias(f"_o_{f}") for f in OVERRIDABLE])
    differs = F.array_compact(
        F.array(*[F.when(F.col(f"_o_{f}").isNotNull() & ~F.col(f"_o_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in OVERRIDABLE])
    )
    joined = ledger.join(wanted, list(TUPLE)).withColumn("differs", differs).withColumn("flagged", S.is_flagged())
    return joined.select(
        "id", *TUPLE, "match_key", F.array_join("differs", ",").alias("differs"), "flagged",
        ((F.size("differs") == 0) & F.col("flagged")).alias("in_effect"),
    )


def flagged_without_override(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    return ledger.where(S.is_flagged()).join(overrides.select(*TUPLE), list(TUPLE), "left_anti")


def matching_rows(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows sharing a source row's merchant, else its description, with the source's draft values.

    ``sources(household_id, merchant_normalized, description_raw, category, sub, role, cycle)``.
    """
    by_merchant = F.coalesce(F.col("merchant_normalized"), F.lit("")) != ""
    kind = F.when(by_merchant, "m").otherwise("d")
    value = F.when(by_merchant, F.col("merchant_normalized")).otherwise(F.col("description_raw"))
    drafts = sources.select("household_id", kind.alias("_kind"), value.alias("_value"), "category", "sub", "role", "cycle")
    named = F.array(
        F.struct(F.lit("m").alias("_kind"), F.col("merchant_normalized").alias("_value")),
        F.struct(F.lit("d").alias("_kind"), F.col("description_raw").alias("_value")),
    )
    return (
        ledger.withColumn("_k", F.explode(named))
        .select("*", "_k.*")
        .where(F.col("_value").isNotNull())
        .join(drafts, ["household_id", "_kind", "_value"])
        .drop("_k", "_kind", "_value")
    )


def bulk_override(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Override requests for every row that matches a source row.

    Empty draft values leave a field alone, and a subcategory counts only together with a
    category: an override holds no "set to nothing" value, so a blank one leaves the row's.
    """
    rows = matching_rows(ledger, sources)

    def given(name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name))

    chosen = given("category").isNotNull()
    return override_requests(
        rows,
        primary_category=given("category"),
        subcategory=F.when(chosen, given("sub")),
        household_role=given("role"),
        lifecycle=given("cycle"),
    )


def rename_label(ledger: DataFrame, field: str, old: str, new: str, note: str = "") -> DataFrame:
    """Override requests that rename one label value everywhere it occurs."""
    return override_requests(ledger.where(F.col(field) == old), **{field: new, "note": note})

"""Ledger and state tables: keyed upserts, audit rows, state export and restore plan."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators.common import newest_per_key
from tallyframe.schema import LEDGER
from tallyframe.session import cut_lineage

RECORD_KEY = ("account_id", "source_record_key")
EXPORT_NULL = r"\N"


def newest_batch(rows: DataFrame, order: Column | str | None = None, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """One row per record key: the last by ``order`` (ties by document name)."""
    last = F.col(order) if isinstance(order, str) else order
    columns = [last.desc()] if last is not None else []
    return newest_per_key(rows, keys, *columns, F.col("source_document_name").desc())


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str] = RECORD_KEY, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Stored rows with the batch's rows in place of equal keys; replaced rows keep ``keep``.

    The stored side is only filtered and looked up, never regrouped, so a small batch
    joins it without moving it.
    """
    kept = stored.join(batch.select(*keys), list(keys), "left_anti")
    held = stored.join(batch.select(*keys), list(keys), "left_semi").select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
    merged = batch.join(held, list(keys), "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in keep})
    return kept.unionByName(merged.select(*stored.columns))


def upsert_counts(stored: DataFrame, batch: DataFrame, keys: Sequence[str] = RECORD_KEY, scope: Sequence[str] = ("account_id",)) -> DataFrame:
    """Rows that would be inserted and updated."""
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    return batch.join(known, list(keys), "left").groupBy(*scope).agg(
        F.count_if(F.col("_known").isNull()).alias("would_insert"), F.count_if(F.col("_known").isNotNull()).alias("would_update")
    )


def upsert_accounts(accounts: DataFrame, found: DataFrame, order: str | None = None) -> DataFrame:
    """The account dimension with the newest description of every account."""
    newest = newest_per_key(found, ["account_id"], F.col(order).desc()) if order else found.dropDuplicates(["account_id"])
    return accounts.join(newest.select("account_id"), "account_id", "left_anti").unionByName(newest.select(*accounts.columns))


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number of the newest complete manifest, and the folder that holds each month; 0 and nothing for a new ledger."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/seq=*/_SUCCESS")
    done = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    newest = max((int(x.getPath().getParent().getName().removeprefix("seq=")) for x in done), default=0)
    if not newest:
        return 0, {}
    return newest, {r["month"]: r["folder"] for r in spark.read.parquet(f"{path}/manifest/seq={newest:08d}").collect()}


def read_ledger(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """The stored ledger, or some of its months; an absent path is an empty ledger.

    The manifest names one folder per month, so months that are not asked for are not even listed.
    """
    _, folders = _manifest(spark, path)
    wanted = sorted(folders if months is None else folders.keys() & set(months))
    if not wanted:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*[f"{path}/data/{folders[m]}/month={m}" for m in wanted])


def touched_months(batch: DataFrame) -> list[str]:
    """The months a batch writes to: a short list, used to prune the stored ledger."""
    return sorted(r["m"] for r in batch.select(S.month_label("occurred_on").alias("m")).distinct().collect())


def with_neighbours(months: Sequence[str]) -> list[str]:
    """The months, and for each the one before and the one after."""
    numbers = {int(m[:4]) * 12 + int(m[5:]) - 1 + d for m in months for d in (-1, 0, 1)}
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in sorted(numbers)]


def write_months(rows: DataFrame, path: str, months: Sequence[str] = ()) -> None:
    """Put ``rows`` in place of the stored rows of their months and of ``months``; other months stay.

    Rows go to a new folder first. A manifest that names the folder of every month is written last
    and counts once Spark has committed it, so readers see the ledger before or after the write, and
    a write that dies in between changes nothing. One writer at a time.
    """
    spark = rows.sparkSession
    number, folders = _manifest(spark, path)
    # Settled, as the rows may read from the folders they replace and are used twice.
    settled = cut_lineage(rows.withColumn("month", S.month_label("occurred_on")))
    folder = f"v{number + 1:08d}-{uuid.uuid4().hex[:12]}"
    # Rebalancing gathers small months and splits large ones by size, so no file count is guessed.
    settled.hint("rebalance", "month").write.partitionBy("month").parquet(f"{path}/data/{folder}")
    written = {r["month"] for r in settled.select("month").distinct().collect()}
    held = {m: f for m, f in folders.items() if m not in written and m not in set(months)} | {m: folder for m in written}
    _commit(spark, f"{path}/manifest/seq={number + 1:08d}", held)


def _commit(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    table = spark.createDataFrame(sorted(folders.items()), "month string, folder string")
    table.coalesce(1).write.mode("overwrite").parquet(path)


def merge_statement(target: str, source: str, columns: Sequence[str], keys: Sequence[str] = RECORD_KEY) -> str:
    """The same upsert as one MERGE, for catalogs whose table format supports it."""
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    sets = ", ".join(f"t.{c} = s.{c}" for c in columns if c not in (*keys, "id"))
    names, values = ", ".join(columns), ", ".join(f"s.{c}" for c in columns)
    return (
        f"MERGE INTO {target} t USING {source} s ON {on} "
        f"WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    )


def audit_rows(files: DataFrame, imported_at: Column) -> DataFrame:
    """One import row per ingested file; the key is derived, so a retried run repeats it."""
    return files.where("status = 'ingested'").select(
        S.digest(32, F.col("source_document_name"), F.col("layout"), imported_at).alias("import_batch_id"),
        F.col("source_document_name").alias("source_name"),
        "layout",
        imported_at.alias("imported_at"),
        (F.col("inserted") + F.col("updated")).alias("row_count"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_state(table: DataFrame, path: str, order: Sequence[str] = ("created_at", "id")) -> None:
    """A table as CSV in a stable order, null written as ``\\N`` and the empty string as ``""``."""
    flat = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns])
    flat.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", EXPORT_NULL).option(
        "emptyValue", '""'
    ).option("escape", '"').csv(path)


def read_export(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """An exported table with the types of ``like``."""
    text = spark.read.csv(path, header=True, nullValue=EXPORT_NULL, emptyValue="", escape='"', inferSchema=False)
    if text.columns != like.columns:
        raise ValueError(f"export columns {text.columns} do not match {like.columns}")
    return text.select(*[F.col(n).cast(t).alias(n) for n, t in like.dtypes])


def restore_plan(stored: DataFrame, export: DataFrame, key: str) -> DataFrame:
    """What a restore would do per key: insert, update (with the changed columns), unchanged, not_in_export.

    A key that occurs twice in the export is an error row.
    """
    others = [c for c in export.columns if c != key]
    counted = export.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_e_{c}") for c in others])
    both = stored.withColumn("_stored", F.lit(True)).join(counted, key, "full_outer")
    changed = F.array_join(
        F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_e_{c}")), F.lit(c)) for c in others])), ","
    )
    action = (
        F.when(F.col("_n") > 1, "duplicate_key")
        .when(F.col("_n").isNull(), "not_in_export")
        .when(F.col("_stored").isNull(), "insert")
        .when(F.col("changed") != "", "update")
        .otherwise("unchanged")
    )
    return both.withColumn("changed", changed).withColumn("action", action).select(
        key, "action", F.when(F.col("action") == "update", F.col("changed")).alias("changed")
    )


def apply_restore(stored: DataFrame, export: DataFrame, key: str) -> DataFrame:
    """Stored rows with the export's rows inserted or in place of equal keys."""
    return stored.join(export.select(key), key, "left_anti").unionByName(export.select(*stored.columns))

"""Streaming ingest: watch a folder, keep an event log, live counters, late-month recomputation.

The streams are stateless; the stored tables are the state. Record keys come from row
content, so a replayed micro-batch writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.operators import rules as R
from tallyframe.operators import summaries
from tallyframe.plans import ingest
from tallyframe.sources.layouts import Layout, parse
from tallyframe.sources.statements import clean_name, is_candidate
from tallyframe.sources.store import read_ledger

EVENT_LOG_KEEP = 100
EVENT_LOG_SHOWN = 25


def statement_stream(spark: SparkSession, folder: str, layout: Layout, header: Sequence[str]) -> DataFrame:
    """Rows of statement files as they arrive; ``header`` is the column order of this folder's exports."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    named = {clean_name(h): h for h in header}
    # Every file is checked against the header, so a changed column order fails instead of shifting values.
    source = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).csv(folder)
    path = F.col("_metadata.file_path")
    wanted = [*layout.required, *layout.optional]
    columns = [(F.col(f"`{named[w]}`") if w in named else F.lit(None).cast("string")).alias(w) for w in wanted]
    return source.select(
        *columns, F.col("_metadata.file_name").alias("source_document_name"), path.alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"),
    )


def watch_folder(
    spark: SparkSession,
    folder: str,
    layout: Layout,
    header: Sequence[str],
    *,
    ledger_path: str,
    events_path: str,
    checkpoint: str,
    rules: R.Rules,
    overrides: DataFrame,
    household: str = "household",
    after: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Ingest every new file once and log it; stops when the folder is drained (``availableNow``)."""

    def take(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # the month list, the upsert and the event log read it
        rows = parse(batch, layout, household=household)
        fresh = ingest.ledger_rows(rows, F.lit(f"{layout.name}-{epoch}"))
        ingest.ingest_into(spark, ledger_path, fresh, rules, overrides)
        events = batch.groupBy("path", "modified", "size").agg(F.count("*").alias("row_count"))
        log_events(spark, events_path, events, epoch)
        if after is not None:
            after(fresh, epoch)
        batch.unpersist()

    stream = statement_stream(spark, folder, layout, header)
    relative = F.substring_index("path", "/", -1)
    return (
        stream.where(is_candidate(relative))
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _last_log(spark: SparkSession, events_path: str, before: int | None = None) -> DataFrame | None:
    """The log as the newest epoch left it; epochs are told by their folders, no file is read for that."""
    try:
        log = spark.read.parquet(events_path)
    except AnalysisException:  # no epoch has been written
        return None
    epochs = log.select("epoch").distinct() if before is None else log.where(F.col("epoch") < before).select("epoch").distinct()
    newest = epochs.agg(F.max("epoch").alias("epoch")).first()["epoch"]
    return None if newest is None else log.where(F.col("epoch") == newest).drop("epoch")


def log_events(spark: SparkSession, events_path: str, events: DataFrame, epoch: int, keep: int = EVENT_LOG_KEEP) -> None:
    """The newest ``keep`` events up to ``epoch``, in a folder of its own: an epoch that runs again writes the same rows."""
    earlier = _last_log(spark, events_path, epoch)
    every = events if earlier is None else earlier.unionByName(events)
    newest = every.orderBy(F.col("modified").desc(), F.col("path")).limit(keep)
    newest.write.mode("overwrite").parquet(f"{events_path}/epoch={epoch}")


def recent_events(spark: SparkSession, events_path: str, shown: int = EVENT_LOG_SHOWN) -> DataFrame:
    """The newest file events, newest first."""
    log = _last_log(spark, events_path)
    if log is None:
        raise ValueError(f"no events in {events_path}")
    return log.orderBy(F.col("modified").desc(), F.col("path")).limit(shown)


def rows_once(ledger_stream: DataFrame, moment: str = "occurred_at", late: str = "3650 days") -> DataFrame:
    """Rows of a stream without repeats of a record key; keys are forgotten once ``late`` behind the newest moment."""
    return ledger_stream.withWatermark(moment, late).dropDuplicatesWithinWatermark(["account_id", "source_record_key"])


def drained(stream: DataFrame, folder: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all there is, batch by batch, with its state under ``folder``.

    Started again with the same folder after a failure, it goes on at the batch that was cut short.
    """
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def latest_counters(counters: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """Run live counters to the end in update mode: the newest row of each key."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/epoch={epoch}")

    drained(counters, folder, "update", write)
    values = [c for c in counters.columns if c not in keys]
    updates = counters.sparkSession.read.parquet(f"{folder}/updates")
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v")).select(*keys, "_v.*")


def source_counters(ledger_stream: DataFrame) -> DataFrame:
    """Live rows per source document (update mode)."""
    return ledger_stream.groupBy("source_document_name").agg(F.count("*").alias("row_count"))


def unclassified_counter(ledger_stream: DataFrame) -> DataFrame:
    """Live size of the unclassified backlog per household."""
    return ledger_stream.where(P.is_unclassified_backlog()).groupBy("household_id").agg(F.count("*").alias("total"))


def refresh_months(spark: SparkSession, ledger_path: str, summary_path: str, fresh: DataFrame) -> None:
    """Recompute the cash-flow months a batch touched, late ones too, and overwrite only those."""
    months = [r["m"] for r in fresh.select(S.month_label("occurred_on").alias("m")).distinct().collect()]
    if not months:
        return
    ledger = read_ledger(spark, ledger_path, months)
    summaries.monthly_flow(ledger).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "month"
    ).parquet(summary_path)

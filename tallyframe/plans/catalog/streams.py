"""Streams over the tables, run to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.registry import query
from tallyframe.sources import sample_ledger as L
from tallyframe.streaming import watch


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, for what a stream keeps."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def orders_stream(spark: SparkSession, d: str) -> DataFrame:
    """The orders as they would arrive, file by file."""
    schema = L.table(spark, d, "orders").schema
    # a pattern, as the table may be one file, and a stream's own path has to be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/orders.parque[t]")


def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    return L.orders_ledger(spark, d, describe=False, orders=orders_stream(spark, d))


@query("str1_rows_once", "ol", "SELECT id, account_id, household_id, CAST(amount AS DOUBLE) AS amount FROM ol")
def rows_once(spark: SparkSession, d: str) -> DataFrame:
    """A stream in which every fifth row arrives twice, and every 35th three times: each record once."""
    rows = L.orders_ledger(spark, d, describe=False, orders=orders_stream(spark, d)).withColumns(
        {"source_record_key": F.col("id"), "occurred_at": F.col("occurred_on").cast("timestamp")}
    )
    number = F.substring("id", 2, L.ID_WIDTH).cast("bigint")
    times = F.when(number % 35 == 0, 3).when(number % 5 == 0, 2).otherwise(1)
    again = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), times))).drop("_i")
    folder = _folder(spark, "str1")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select("id", "account_id", "household_id", F.col("amount").cast("double").alias("amount")).write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    watch.drained(watch.rows_once(again), folder, "append", write)
    return spark.read.parquet(f"{folder}/rows").drop("epoch")


@query("str2_recent_events", "ol", """
SELECT source_document_name AS path, count(*) AS row_count FROM ol GROUP BY 1 ORDER BY 1 DESC LIMIT 25
""")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    """The log of documents that a stream brought, newest name first; each epoch keeps a bounded log."""
    folder = _folder(spark, "str2")
    named = ledger_stream(spark, d).groupBy("source_document_name").agg(F.count("*").alias("row_count"))

    def write(batch: DataFrame, epoch: int) -> None:
        events = batch.select(F.col("source_document_name").alias("path"), F.col("source_document_name").alias("modified"), "row_count")
        watch.log_events(spark, f"{folder}/log", events, epoch)

    watch.drained(named, folder, "complete", write)
    return watch.recent_events(spark, f"{folder}/log").select("path", "row_count")


@query("str3_source_counters", "ol", "SELECT source_document_name, count(*) AS row_count FROM ol GROUP BY 1")
def source_counters(spark: SparkSession, d: str) -> DataFrame:
    return watch.latest_counters(watch.source_counters(ledger_stream(spark, d)), ["source_document_name"], _folder(spark, "str3"))


@query("str4_unclassified_counter", "ol", """
SELECT household_id, count(*) AS total FROM ol WHERE primary_category = 'unclassified' AND direction <> 'transfer' GROUP BY 1
""")
def unclassified_counter(spark: SparkSession, d: str) -> DataFrame:
    return watch.latest_counters(watch.unclassified_counter(ledger_stream(spark, d)), ["household_id"], _folder(spark, "str4"))

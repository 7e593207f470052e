"""Streams that are cut short and started again, late repeats, and a log that stays short."""

from __future__ import annotations

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyframe.streaming import watch

ROWS = "id string, account_id string, source_record_key string, occurred_at timestamp, source_document_name string"


def files(spark, folder, parts):
    """One file per part, in an order of their own times."""
    stamp = datetime.datetime(2024, 1, 1)
    for i, keys in enumerate(parts):
        rows = [(f"{k}-{i}", "a", k, stamp + datetime.timedelta(days=i), f"f{i}.csv") for k in keys]
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stream_cut_short_goes_on_where_it_was(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    files(spark, source, [["x", "y"], ["y", "z"], ["x", "w"], ["z", "z"]])
    deaths = [2]

    def write(batch, epoch):
        if epoch in deaths:
            deaths.remove(epoch)
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{state}/rows/epoch={epoch}")

    with pytest.raises(StreamingQueryException, match="lost"):
        watch.drained(watch.rows_once(stream(spark, source)), state, "append", write)
    assert not deaths
    watch.drained(watch.rows_once(stream(spark, source)), state, "append", write)
    got = spark.read.parquet(f"{state}/rows")
    assert sorted(r["source_record_key"] for r in got.collect()) == ["w", "x", "y", "z"]
    # all has been read: a third run brings nothing
    watch.drained(watch.rows_once(stream(spark, source)), state, "append", write)
    assert spark.read.parquet(f"{state}/rows").count() == 4


def test_counters_in_update_mode_end_as_a_batch_does(spark, tmp_path):
    source = str(tmp_path / "in")
    files(spark, source, [["x", "y"], ["y"], ["x", "w"]])
    rows = stream(spark, source).withColumn("source_document_name", F.col("source_record_key"))
    got = watch.latest_counters(watch.source_counters(rows), ["source_document_name"], str(tmp_path / "state"))
    assert {r["source_document_name"]: r["row_count"] for r in got.collect()} == {"x": 2, "y": 2, "w": 1}


def test_the_log_keeps_a_bounded_number_of_events(spark, tmp_path):
    log = str(tmp_path / "log")
    for epoch in range(4):
        events = spark.createDataFrame([(f"p{epoch}{i}", epoch * 10 + i, 1) for i in range(3)], "path string, modified long, row_count long")
        for _ in range(1 + epoch % 2):  # an epoch that runs again leaves the same log
            watch.log_events(spark, log, events, epoch, keep=5)
    assert spark.read.parquet(log).where("epoch = 3").count() == 5
    assert [r["path"] for r in watch.recent_events(spark, log, shown=4).collect()] == ["p32", "p31", "p30", "p22"]

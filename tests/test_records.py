"""Records of text files cut anywhere, against Python's csv reader."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.sources import layouts, records, routing, statements


@pytest.fixture
def tiny_splits(spark):
    """Files are cut every 64 bytes, each cut in a task of its own."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "64"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def cell(rng):
    text = "".join(rng.choice(("a", "b c", ",", "\n", '"', "é", "", "x" * 30, " ")) for _ in range(rng.randrange(4)))
    if rng.random() < 0.1:
        return "5" + '"' + " pipe", False  # a quote inside a bare field is a sign like others
    return text, any(c in text for c in ',\n"') or rng.random() < 0.2


def file_text(rng, n):
    lines = []
    for _ in range(n):
        cells = [cell(rng) for _ in range(3)]
        lines.append(",".join('"' + t.replace('"', '""') + '"' if q else t for t, q in cells))
    return "h1,h 2,H3\n" + "\n".join(lines) + "\n"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_are_those_of_a_csv_reader(spark, tmp_path, tiny_splits, seed):
    rng, want = random.Random(seed), {}
    for i in range(3):
        text = file_text(rng, (40, 1, 0)[i])
        (tmp_path / f"f{i}.csv").write_text(text, encoding="utf-8", newline="")
        rows = list(csv.reader(io.StringIO(text, newline="")))[1:]
        want[f"f{i}.csv"] = [[x or None for x in row] for row in rows if row and not (len(row) == 1 and not row[0].strip())]
    found = records.read_records(spark, str(tmp_path))
    got = {name: [] for name in want}
    for r in found.select("source_document_name", records.fields(F.col("record")).alias("v")).collect():
        got[r["source_document_name"]].append([x or None for x in r["v"]])
    key = lambda row: [x or "" for x in row]
    assert {n: sorted(rows, key=key) for n, rows in got.items()} == {n: sorted(rows, key=key) for n, rows in want.items()}
    blocks = records.lines_of(spark, str(tmp_path)).select("path", "block").distinct().count()
    assert blocks > 3


def test_one_long_record_over_many_blocks(spark, tmp_path, tiny_splits):
    note = "line\n" * 200 + "end"
    (tmp_path / "f.csv").write_text(f'a,b\n1,plain\n2,"{note}"\n\n3,last\n', encoding="utf-8")
    got = {r["v"][0]: r["v"][1] for r in records.read_records(spark, str(tmp_path)).select(records.fields(F.col("record")).alias("v")).collect()}
    assert got == {"1": "plain", "2": note, "3": "last"}


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path, tiny_splits):
    lines = ["01/05/2026,01/06/2026,SHOP %d,,Sale,-1.00," % i for i in range(300)]
    (tmp_path / "2026-01_Card.csv").write_text("Transaction Date,Post Date,Description,Category,Type,Amount,Memo\n" + "\n".join(lines) + "\n")
    (tmp_path / "bad.csv").write_text("Date,Amount\n1,2\n")
    raw, failed = statements.read_statements(spark, str(tmp_path), layouts.CARD_A)
    assert records.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted(r["description"] for r in raw.collect()) == sorted(f"SHOP {i}" for i in range(300))
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in failed.collect()] == [("bad.csv", "missing required columns: description, post_date, transaction_date, type")]


def test_no_file_is_read_before_rows_are_asked_for(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time,Amount,Type,Description\n5/8/2026,9:01:02,1.25,Deposit,Interest Paid\n")
    context, group = spark.sparkContext, "records-planned"
    context.setJobGroup(group, group)
    plan = spark.createDataFrame([(str(tmp_path / "a.csv"), "ally-hysa")], "path string, layout string")
    several = [x for x in layouts.LAYOUTS.values() if not x.numbered]
    rows, failed = routing.parse_routed(plan, str(tmp_path), several)
    assert len(context.statusTracker().getJobIdsForGroup(group)) == 0
    context.setJobGroup("", "")
    assert rows.count() == 1 and failed.count() == 0


def test_several_layouts_in_one_plan_are_those_of_each(spark, tmp_path):
    from test_ingest import CARD_HEADER

    (tmp_path / "c.csv").write_text(CARD_HEADER + "\n" + "01/05/2026,01/06/2026,MICRO,Food,Sale,-1.00,\n" * 3 + ",,PENDING,,Sale,-3.00,\n")
    (tmp_path / "s.csv").write_text("Date,Time,Amount,Type,Description\n5/8/2026,9:01:02,1.25,Deposit,Interest Paid\nx,9:01,1,Deposit,y\n")
    (tmp_path / "d.csv").write_text("Status,Date,Description,Debit,Credit\nCleared,01/02/2026,SHOP,5.00,\nPending,01/02/2026,SHOP,5.00,\n")
    (tmp_path / "e.csv").write_text("Status,Date\nCleared,01/02/2026\n")
    of = {"c.csv": "chase-credit-card", "s.csv": "ally-hysa", "d.csv": "citi-credit-card", "e.csv": "citi-credit-card"}
    plan = spark.createDataFrame([(str(tmp_path / f), n) for f, n in of.items()] + [("nowhere", None)], "path string, layout string")
    rows, failed = routing.parse_routed(plan, str(tmp_path), list(layouts.LAYOUTS.values()))
    want = []
    for name in ("c.csv", "s.csv", "d.csv"):
        spec = layouts.LAYOUTS[of[name]]
        want += layouts.parse(statements.read_statements(spark, str(tmp_path / name), spec)[0], spec).collect()
    assert sorted(map(str, rows.collect())) == sorted(map(str, want))
    assert [(r["source_document_name"], r["layout"]) for r in failed.collect()] == [("e.csv", "citi-credit-card")]


def test_layouts_apart_agree_with_one_plan(spark):
    """Records given by layout parse to the rows of the common plan, and their literal headers cost nothing per record."""
    from functools import reduce

    from pyspark.sql import DataFrame

    given = [
        (layouts.CARD_B, "Status,﻿ Date ,Description,Debit,_Credit_", ["posted,1/2/2020,SHOP,5.00,", 'Cleared,1/2/20,"A, ""B""","1,200.00",', "posted,1/2/2020,SHOP,5.00,", "Pending,,x,,"]),
        (layouts.SAVINGS_A, 'Date,"Time",Amount,Type,Description', ["2020-02-30,9:01,1,D,x", "2/3/2020,13:00:07,$5,D,Requested transfer to x", ",,,,"]),
        (layouts.CHECKING_B, "Date,Type,Description,Debit,Credit", ["1/2/2020,POS,x,1.00,"]),
    ]
    apart = {
        spec.name: spark.createDataFrame([(r, "f.csv") for r in rows], "record string, source_document_name string").withColumn("header", F.lit(header))
        for spec, header, rows in given
    }
    together = reduce(DataFrame.unionByName, [frame.withColumn("layout", F.lit(name)) for name, frame in apart.items()])
    specs = [spec for spec, _, _ in given]
    for one, both in zip(routing.parse_records(apart, specs), routing.parse_records(together, specs)):
        shown = [c for c in both.columns if c != "metadata"]
        assert sorted(map(str, one.select(shown).collect())) == sorted(map(str, both.select(shown).collect()))
        assert one.count() > 0
    rows, _ = routing.parse_records({"citi-credit-card": apart["citi-credit-card"]}, [layouts.CARD_B])
    assert "array_position" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_bare_and_quoted_records_are_cut_alike(spark):
    """What is cut at commas and what is cut by quotes give the same fields and names."""
    texts = ["", ",", "a,,b", " a , b", "a\nb,c", "_A b_,__,c-d-", "Ä x,1", ",a,"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = frame.select(records.fields(F.col("t")).alias("f"), records.clean_names(F.col("t")).alias("n"))
    quoted = frame.select(records.fields(F.concat(F.col("t"), F.lit(',"q"'))).alias("f"), records.clean_names(F.concat(F.col("t"), F.lit(',"q"'))).alias("n"))
    for one, other in zip(bare.collect(), quoted.collect()):
        assert one["f"] == other["f"][:-1] and one["n"] == other["n"][:-1]


def test_us_dates(spark):
    texts = {"1/2/2020": "2020-01-02", "01/02/69": "1969-01-02", "1/2/68": "2068-01-02", "13/45/2020": None, "1/2/202": None, "1/2/20201": None, "1/2/2020\n": "2020-01-02", "1//2020": None, "1/2": None}
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.us_date("t", True).cast("string").alias("d"))
    assert {r["t"]: r["d"] for r in frame.collect()} == texts


def test_rows_are_shuffled_once_for_their_keys(spark):
    """Repeats are numbered by one shuffle, and by none where no key is asked for."""
    lines = [("01/05/2026,01/06/2026,SHOP %d,-1.00,Sale,," % (i % 3), "2026-01_Card.csv") for i in range(6)]
    found = spark.createDataFrame(lines, "record string, source_document_name string").withColumn("header", F.lit("Transaction Date,Post Date,Description,Amount,Type,Category,Memo"))
    rows, _ = routing.parse_records({"chase-credit-card": found}, [layouts.CARD_A])

    def shuffles(frame):
        return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    assert shuffles(rows.select("amount", "direction", "statement_period")) == 0
    assert shuffles(rows) == 1
    assert {r["statement_period"] for r in rows.collect()} == {"2026-01"}
    assert rows.select("source_record_key").distinct().count() == 6


def test_statement_periods(spark):
    names = {"2026-1.csv": "2026-01", "2026_12_x.csv": "2026-12", "x.2026-01": None, "2026-13.csv": None, "2026-0_2.csv": None, "a 2026-1 2026-2.csv": "2026-01", "12026_05.v2.csv": "2026-05", "2026-130": None, "1999-05.csv": None, "": None}
    frame = spark.createDataFrame([(t,) for t in names], "t string").select("t", S.statement_period("t").alias("p"))
    assert {r["t"]: r["p"] for r in frame.collect()} == names
    assert frame.select(S.statement_period(F.lit(None).cast("string"))).first()[0] is None

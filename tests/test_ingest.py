"""Statement files, layouts, store, streaming: real CSV files in and out."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import overrides as O
from tallyframe.operators import registers, rules, transfers
from tallyframe.plans import ingest
from tallyframe.schema import LEDGER, OVERRIDES
from tallyframe.sources import layouts, routing, statements, store
from tallyframe.streaming import watch

CARD_HEADER = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def card_file(folder, name, *lines, header=CARD_HEADER):
    return write(folder / name, "\n".join([header, *lines]) + "\n")


def parsed(spark, folder, layout=layouts.CARD_A):
    raw, failed = statements.read_statements(spark, str(folder), layout)
    return layouts.parse(raw, layout), failed


def no_overrides(spark):
    return spark.createDataFrame([], OVERRIDES)


def test_card_files(spark, tmp_path):
    card_file(
        tmp_path, "2026-01_Card.csv",
        '01/05/2026,01/06/2026,"COFFEE, SHOP",Food,Sale,-4.50,',
        "01/05/2026,01/06/2026,MICRO,Food,Sale,-1.00,",
        "01/05/2026,01/06/2026,MICRO,Food,Sale,-1.00,",
        "01/05/2026,01/06/2026,MICRO,Food,Sale,-1.00,",
        "1/7/26,,PAYMENT THANK YOU,,Payment,\"$1,234.50\",",
        ",,PENDING ROW,,Sale,-3.00,",
        "02/30/2026,,BAD DATE,,Sale,-3.00,",
        "01/09/2026,,BAD AMOUNT,,Sale,x,",
    )
    # Another column order, a BOM, and a file that lacks a column.
    write(tmp_path / "2026-02_Card.csv", "﻿Type,Amount,Description,Post Date,Transaction Date\nSale,-7.00,LATER,02/02/2026,02/01/2026\n")
    write(tmp_path / "other.csv", "Date,Amount\n01/01/2026,5\n")
    rows, failed = parsed(spark, tmp_path)
    got = {(r["description_raw"], r["amount"]): r for r in rows.where("row_status = 'parsed'").collect()}
    assert got[("COFFEE, SHOP", Decimal("-4.50"))]["direction"] == "outflow"
    payment = got[("PAYMENT THANK YOU", Decimal("1234.50"))]
    assert (payment["direction"], payment["occurred_on"]) == ("transfer", datetime.date(2026, 1, 7))
    later = got[("LATER", Decimal("-7.00"))]
    assert (later["occurred_on"], later["statement_period"]) == (datetime.date(2026, 2, 1), "2026-02")
    micro = rows.where("description_raw = 'MICRO'").select("source_record_key").distinct()
    assert micro.count() == 3
    reasons = {r["row_reason"] for r in layouts.quarantined_rows(rows).collect()}
    assert reasons == {"pending", "unparseable transaction date", "amount is empty or unparseable"}
    bad = failed.collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("other.csv") and "description" in bad[0]["reason"]


def test_masked_description_keeps_the_key(spark):
    cols = "date string, description string, ext string, draft string, amount string, balance string, source_document_name string"
    rows = [("1/5/2026", "ALLY BANK $TRANSFER ID:123", "ACH", "", "-4.00", "10.00", "a.csv"), ("1/5/2026", "ALLY BANK $TRANSFER ID:***", "ACH", "", "-4.00", "10.00", "b.csv"), ("1/5/26", "X", "Y", "", ".46", "1", "b.csv")]
    out = layouts.parse(spark.createDataFrame(rows, cols), layouts.SAVINGS_B).collect()
    good = [r for r in out if r["row_status"] == "parsed"]
    assert len({r["source_record_key"] for r in good}) == 1 and {r["direction"] for r in good} == {"transfer"}
    assert [r["row_reason"] for r in out if r["row_status"] == "error"] == ["unparseable date"]


def test_overlapping_files_load_once_and_ingest_is_idempotent(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "ledger")
    lines = ["01/05/2026,01/06/2026,NETFLIX.COM,,Sale,-15.00,", "02/05/2026,02/06/2026,WHOLE FOODS,,Sale,-80.00,"]
    card_file(inbox, "2026-01_Card.csv", lines[0])
    card_file(inbox, "YTD_Card.csv", *lines)
    loaded = rules.load_rules(rules.seed_rules(spark))
    assert len(loaded) == 11

    def run():
        rows, _ = parsed(spark, inbox)
        ingest.ingest_into(spark, table, ingest.ledger_rows(rows, F.lit("b1")), loaded, no_overrides(spark))
        return sorted(tuple(r) for r in store.read_ledger(spark, table).drop("metadata").collect())

    first = run()
    assert len(first) == 2
    assert run() == first
    got = {r["description_raw"]: r for r in store.read_ledger(spark, table).collect()}
    assert got["WHOLE FOODS"]["primary_category"] == "variable_lifestyle"
    assert got["WHOLE FOODS"]["metadata"]["classifier_rule_id"] == "rule-whole-foods"
    assert got["NETFLIX.COM"]["primary_category"] == "unclassified"
    # A late file touches only its month and keeps the other one.
    card_file(inbox, "2026-02b_Card.csv", "02/07/2026,02/08/2026,AMZN MKTP,,Sale,-9.00,")
    assert len(run()) == 3


def ledger_row(i, account, day, amount, direction, category="unclassified", text="x", **more):
    base = dict(
        household_id="h", id=f"r{i}", account_id=account, import_batch_id="b", source_record_key=f"k{i}", source_document_name="f.csv",
        occurred_on=datetime.date.fromisoformat(day), posted_on=None, description_raw=text, merchant_normalized=None, amount=Decimal(amount),
        direction=direction, currency="USD", primary_category=category, subcategory=None, household_role="joint", lifecycle="recurring",
        transfer_group_key=None, statement_period=None, metadata={},
    )
    base.update(more)
    return base


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[n] for n in LEDGER.fieldNames()) for r in rows], LEDGER)


def test_reimported_leg_pairs_again(spark, tmp_path):
    """A re-import resets category and group; the close classifies and pairs both legs again."""
    table = str(tmp_path / "ledger")
    loaded = rules.load_rules(rules.seed_rules(spark))
    legs = frame(
        spark, ledger_row(1, "a", "2026-01-10", "-50", "transfer"), ledger_row(2, "b", "2026-01-12", "50", "transfer"),
        ledger_row(3, "a", "2025-06-10", "-9", "transfer"), ledger_row(4, "b", "2025-06-10", "9", "transfer"),
    )
    ingest.ingest_into(spark, table, legs, loaded, no_overrides(spark))
    before = {r["id"]: r["transfer_group_key"] for r in store.read_ledger(spark, table).collect()}
    assert before["r1"] == before["r2"] is not None and before["r3"] == before["r4"] is not None
    again = frame(spark, ledger_row(9, "a", "2026-01-10", "-50", "transfer", source_record_key="k1"))
    ingest.ingest_into(spark, table, again, loaded, no_overrides(spark))
    after = {r["id"]: r["transfer_group_key"] for r in store.read_ledger(spark, table).collect()}
    assert after == before


def test_pairs_beyond_the_read_months_stay(spark, tmp_path):
    """A leg in a month that is not read does not free its partner."""
    table = str(tmp_path / "ledger")
    loaded = rules.load_rules(rules.seed_rules(spark))
    ingest.ingest_into(
        spark, table,
        frame(spark, ledger_row(1, "a", "2026-01-31", "-50", "transfer"), ledger_row(2, "b", "2026-02-02", "50", "transfer")),
        loaded, no_overrides(spark),
    )
    key = store.read_ledger(spark, table).first()["transfer_group_key"]
    ingest.ingest_into(spark, table, frame(spark, ledger_row(3, "a", "2026-03-20", "-1", "outflow")), loaded, no_overrides(spark))
    assert {r["transfer_group_key"] for r in store.read_ledger(spark, table).where("id <> 'r3'").collect()} == {key}


def test_far_months_are_neither_read_nor_rewritten(spark, tmp_path):
    table = str(tmp_path / "ledger")
    loaded = rules.load_rules(rules.seed_rules(spark))
    days = [f"20{y}-{m:02d}-10" for y in (16, 26) for m in (1, 2, 3, 4, 5)]
    ingest.ingest_into(spark, table, frame(spark, *[ledger_row(i, "a", d, "-1", "outflow") for i, d in enumerate(days)]), loaded, no_overrides(spark))
    before = store._manifest(spark, table)[1]
    read = store.read_ledger(spark, table, ["2026-01"])
    assert len(read.collect()) == 1 and all("month=2026-01" in f for f in read.inputFiles())
    late = frame(spark, ledger_row(20, "a", "2016-01-11", "-2", "outflow"), ledger_row(21, "a", "2026-05-11", "-2", "outflow"))
    ingest.ingest_into(spark, table, late, loaded, no_overrides(spark))
    after = store._manifest(spark, table)[1]
    assert {m for m in after if after[m] != before[m]} == {"2016-01", "2016-02", "2026-04", "2026-05"}
    assert store.read_ledger(spark, table).count() == 12


@pytest.mark.parametrize("step", ["_commit", "month_label"])
def test_a_write_that_dies_loses_no_row(spark, tmp_path, monkeypatch, step):
    table = str(tmp_path / "ledger")
    loaded = rules.load_rules(rules.seed_rules(spark))
    ingest.ingest_into(spark, table, frame(spark, ledger_row(1, "a", "2026-01-10", "-1", "outflow")), loaded, no_overrides(spark))
    more = frame(spark, ledger_row(2, "a", "2026-01-11", "-2", "outflow"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):

        def die(*_):
            raise RuntimeError("died")

        m.setattr(store if step == "_commit" else store.S, step, die)
        ingest.ingest_into(spark, table, more, loaded, no_overrides(spark))
    assert [r["id"] for r in store.read_ledger(spark, table).collect()] == ["r1"]
    ingest.ingest_into(spark, table, more, loaded, no_overrides(spark))
    assert store.read_ledger(spark, table).count() == 2


def test_state_export_and_restore(spark, tmp_path):
    table = spark.createDataFrame(
        [("a", None, "x,y", datetime.datetime(2026, 1, 2)), ("b", "", 'say "hi"', datetime.datetime(2026, 1, 1))],
        "id string, primary_category string, note string, created_at timestamp",
    )
    path = str(tmp_path / "export")
    store.export_state(table, path)
    back = store.read_export(spark, path, table)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    changed = table.withColumn("note", F.when(F.col("id") == "a", "edited").otherwise(F.col("note"))).where("id <> 'b'").unionByName(
        table.where("id = 'b'").withColumn("id", F.lit("c"))
    )
    plan = {r["id"]: (r["action"], r["changed"]) for r in store.restore_plan(changed, back, "id").collect()}
    assert plan == {"a": ("update", "note"), "b": ("insert", None), "c": ("not_in_export", None)}
    restored = store.apply_restore(changed, back, "id")
    assert {r["action"] for r in store.restore_plan(restored.where("id <> 'c'"), back, "id").collect()} == {"unchanged"}
    twice = back.unionByName(back.where("id = 'a'"))
    assert {r["action"] for r in store.restore_plan(table, twice, "id").where("id = 'a'").collect()} == {"duplicate_key"}


def test_sidecar_and_catalogue(spark, tmp_path):
    path = write(tmp_path / "check_register.csv", "# template\naccount,check_number,date_written,amount,payee\n# an example\nChecking,209,2026-01-02,$50.00,Plumber\n")
    entries = statements.read_sidecar(spark, path, registers.CHECK_REQUIRED, ("primary_category", "notes"))
    assert entries.count() == 1
    accounts = spark.createDataFrame([("acct-1", "checking")], "account_id string, account_name string")
    ledger = frame(spark, ledger_row(1, "acct-1", "2026-01-09", "-50", "outflow", text="CHECK# 0209"), ledger_row(2, "acct-1", "2026-01-05", "-50", "outflow", text="CHECK# 1209"))
    out = registers.check_register(entries, accounts, ledger).first()
    assert (out["outcome"], out["transaction_id"], out["tier"]) == ("matched", "r1", "strict")
    with pytest.raises(ValueError, match="missing required columns"):
        statements.read_sidecar(spark, path, ("nope",))
    for name in ("a.csv", "archive/b.csv", "_held/c.csv", ".git/d.csv", "deep/er/e.pdf", "notes.md", "docs/f.csv"):
        write(tmp_path / "root" / name, "x")
    found = statements.file_catalogue(spark, str(tmp_path / "root"))
    assert {r["relative_path"] for r in found.collect()} == {"a.csv", "deep/er/e.pdf"}
    sources = spark.createDataFrame(
        [("doc-001", 1, "A. Core", "Card activity", "card", "spend", "CSV", ""), ("doc-002", 2, "B. Other", "Tax return", "tax", "filing", "PDF", "")],
        "source_id string, position int, category string, document string, subject string, why_needed string, format string, obtained string",
    )
    files = spark.createDataFrame([("inbox/CardActivity_2026-01.csv",), ("inbox/zzz.bin",)], "path string")
    routed = routing.dispatch(routing.route_files(files, sources), layouts.LAYOUT_OF_SOURCE)
    assert {r["path"]: (r["source_id"], r["layout"], r["status"]) for r in routed.collect()} == {
        "inbox/CardActivity_2026-01.csv": ("doc-001", "chase-credit-card", "routed"),
        "inbox/zzz.bin": (None, None, "no_parser"),
    }


def test_parse_routed_and_accounts(spark, tmp_path):
    card = card_file(tmp_path, "CardActivity_2026-01.csv", "01/05/2026,01/06/2026,A,,Sale,-4.50,")
    save = write(tmp_path / "Savings_2026-01.csv", "Date,Time,Amount,Type,Description\n5/8/2026,9:01:02,1.25,Deposit,Interest Paid\n")
    plan = spark.createDataFrame([(card, "chase-credit-card"), (save, "ally-hysa"), ("x", None)], "path string, layout string")

    rows, failed = routing.parse_routed(plan, str(tmp_path), list(layouts.LAYOUTS.values()))
    assert failed.collect() == []
    assert {(r["account_id"], r["direction"]) for r in rows.collect()} == {("acct-chase-credit-card", "outflow"), ("acct-ally-hysa", "inflow")}
    assert {(r["account_id"], r["account_type"]) for r in layouts.accounts_of(rows).collect()} == {
        ("acct-chase-credit-card", "credit_card"), ("acct-ally-hysa", "savings"),
    }
    summary = layouts.file_summary(rows, rows.where("1 = 0"))
    audit = store.audit_rows(summary, F.lit("2026-01-01").cast("timestamp"))
    path = str(tmp_path / "audit")
    store.append_audit(audit, path)
    assert spark.read.parquet(path).agg(F.sum("row_count")).first()[0] == 2
    assert "MERGE INTO ledger" in store.merge_statement("ledger", "batch", LEDGER.fieldNames())


def test_watch_folder(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "ledger")
    events, monthly = str(tmp_path / "events"), str(tmp_path / "monthly")
    loaded = rules.load_rules(rules.seed_rules(spark))
    header = CARD_HEADER.split(",")

    def drain():
        query = watch.watch_folder(
            spark, str(inbox), layouts.CARD_A, header, ledger_path=table, events_path=events, checkpoint=str(tmp_path / "cp"),
            rules=loaded, overrides=no_overrides(spark),
            after=lambda fresh, _: watch.refresh_months(spark, table, monthly, fresh),
        )
        query.awaitTermination()

    card_file(inbox, "2026-01_Card.csv", "01/05/2026,01/06/2026,WHOLE FOODS,,Sale,-80.00,", "02/05/2026,02/06/2026,WHOLE FOODS,,Sale,-20.00,")
    drain()
    totals = {r["month"]: float(r["outflow"]) for r in spark.read.parquet(monthly).collect()}
    assert totals == {"2026-01": 80.0, "2026-02": 20.0}
    # A late file changes a closed month; the other month is left as it was.
    card_file(inbox, "2026-01-late_Card.csv", "01/20/2026,01/21/2026,WHOLE FOODS,,Sale,-5.00,")
    drain()
    totals = {r["month"]: float(r["outflow"]) for r in spark.read.parquet(monthly).collect()}
    assert totals == {"2026-01": 85.0, "2026-02": 20.0}
    assert store.read_ledger(spark, table).count() == 3
    assert [r["row_count"] for r in watch.recent_events(spark, events).collect()] == [1, 2]


def test_live_counters(spark, tmp_path):
    path = str(tmp_path / "ledger")
    frame(spark, ledger_row(1, "a", "2026-01-10", "-50", "outflow"), ledger_row(2, "a", "2026-01-10", "50", "transfer")).write.parquet(path)
    stream = spark.readStream.schema(LEDGER).parquet(path)
    for name, counted, expected in (("per_source", watch.source_counters(stream), ("f.csv", 2)), ("backlog", watch.unclassified_counter(stream), ("h", 1))):
        query = counted.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        assert tuple(spark.table(name).first()) == expected


def test_override_survives_and_fans_out(spark):
    rows = frame(
        spark, ledger_row(1, "a", "2026-01-10", "-50", "outflow", text="Cafe  One"), ledger_row(2, "a", "2026-01-10", "-50", "outflow", text="cafe one"),
        ledger_row(3, "a", "2026-01-11", "-50", "outflow", text="cafe one"),
    )
    request = O.override_requests(rows.where("id = 'r1'"), lifecycle="one_time", note="first")
    stored = O.upsert_overrides(no_overrides(spark), request)
    again = O.upsert_overrides(stored, O.override_requests(rows.where("id = 'r2'"), primary_category="medical"))
    assert again.count() == 1 and again.first()["note"] == "first"
    out = {r["id"]: r for r in O.apply_overrides(rows, again).collect()}
    assert (out["r1"]["lifecycle"], out["r2"]["primary_category"], out["r3"]["lifecycle"]) == ("one_time", "medical", "recurring")
    assert out["r1"]["metadata"] == {"manual_override_applied": "true", "manual_override_note": "first"}


def test_pairing_needs_classification_first(spark):
    legs = frame(spark, ledger_row(1, "a", "2026-01-10", "-50", "transfer"), ledger_row(2, "b", "2026-01-10", "50", "transfer"))
    assert transfers.pair_transfers(legs).count() == 0
    classified = rules.classify(legs, rules.load_rules(rules.seed_rules(spark)), no_overrides(spark))
    assert transfers.pair_transfers(classified).count() == 1

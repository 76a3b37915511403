import json

import pytest
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.operators import approvals
from tallyweave.plans.reconcile import reconcile, settle
from tallyweave.session import tune
from tallyweave.sources import audit, tables
from tallyweave.streaming import reconcile_stream as streams
from tests.helpers import ledger, record, submissions


def test_select_guard(spark):
    book = ledger(spark, record())
    rows = tables.run_select(
        spark, "  select vendor FROM book WHERE amount > :least", {"book": book}, {"least": 5.0}
    )
    assert rows.count() == 1
    for text in ("", "   ", "DROP TABLE book", "INSERT INTO book VALUES (1)"):
        with pytest.raises(ValueError):
            tables.run_select(spark, text, {"book": book})


def test_manifest_round_trip(spark, tmp_path):
    array_file = tmp_path / "manifest.json"
    array_file.write_text(
        '[{"case_id": "c-1", "scenario": "matched", "image_path": "p.png",'
        ' "document_invoice": {"invoice_id": "A"}, "ledger_record": {"invoice_id": "A",'
        ' "invoice_date": "2026-01-02", "vendor": "V", "amount": 5, "currency": "EUR",'
        ' "quantity": 2, "fx_rate": 1.5,'
        ' "line_items": [{"description": "x", "qty": 2, "price": 2.5}]}}]'
    )
    row = tables.manifest_rows(tables.read_manifest(spark, str(array_file), True)).first()
    assert (row.case_id, str(row.invoice_date), row.amount, row.quantity) == (
        "c-1",
        "2026-01-02",
        5.0,
        2,
    )
    assert row.line_items == '[{"description":"x","qty":2,"price":2.5}]'
    assert row.asDict().keys() == set(S.EVALUATION_LEDGER.names)


def test_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "book")
    tables.append_rows(ledger(spark, record(), record()), path)
    tables.replace_table(ledger(spark, record(vendor="B")), path)
    tables.append_rows(ledger(spark, record(vendor="C")), path)
    assert {r.vendor for r in spark.read.parquet(path).collect()} == {"B", "C"}
    assert tables.scan_ledger(spark.read.parquet(path), "B").columns == S.RECORD_FIELDS


def test_a_table_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "book")
    tables.replace_table(ledger(spark, record(vendor="A"), record(vendor="B")), path)
    tables.replace_table(spark.read.parquet(path).filter("vendor = 'B'"), path)
    assert [r.vendor for r in spark.read.parquet(path).collect()] == ["B"]
    failing = spark.read.parquet(path).withColumn("amount", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        tables.replace_table(failing, path)
    assert [r.vendor for r in spark.read.parquet(path).collect()] == ["B"]
    assert [p.name for p in tmp_path.iterdir() if ".old-" in p.name] == []


def test_audit_trail(spark, tmp_path):
    book = ledger(spark, record())
    subs = submissions(spark, record(), record(amount=1037.5), record(invoice_id="N", vendor=None))
    results = settle(subs, book)
    when = F.to_timestamp(F.concat(F.lit("2026-02-0"), F.col("submission_id") + 1, F.lit(" 08:00:00")))
    events = audit.audit_events(results, "run-7", when)
    assert events.columns == S.AUDIT_EVENT.names
    path = str(tmp_path / "trail")
    audit.append_events(events, path)
    stored = audit.read_events(spark, path)
    assert stored.count() == 3
    plan = audit.read_events(spark, path, "2026-02-02")
    assert plan.count() == 2
    assert "PartitionFilters: [isnotnull(event_date" in plan._jdf.queryExecution().executedPlan().toString()
    rows = audit.list_history(stored).collect()
    assert [str(r.event_timestamp)[:10] for r in rows] == ["2026-02-03", "2026-02-02", "2026-02-01"]
    assert rows[0].vendor is None and rows[0].reconciliation_status == "unmatched"
    assert rows[1].dispute_letter_draft and rows[2].dispute_letter_draft is None
    only = audit.list_history(stored, root_cause="amount_mismatch", severity="high").collect()
    assert len(only) == 1 and audit.list_history(stored, severity="low").count() == 0
    assert audit.list_history(stored, limit=0).count() == 1
    next_page = audit.list_history(stored, after=(rows[0].event_timestamp, rows[0].audit_event_id))
    assert [r.audit_event_id for r in next_page.collect()] == [r.audit_event_id for r in rows[1:]]
    with pytest.raises(ValueError):
        audit.list_history(stored, limit=501)
    shown = {r.invoice_id + r.reconciliation_status: r for r in audit.history_report(stored).collect()}
    assert shown["INV-00001matched"].review_status == "No review required"
    assert shown["INV-00001amount_mismatch"].root_cause == "amount_mismatch"


def test_bad_investigation_json(spark):
    df = spark.createDataFrame(
        [("e", "2026-01-01", "A", "V", "matched", "not json", 5.0, "EUR", 0.5)],
        "audit_event_id string, event_timestamp string, invoice_id string, vendor string, "
        "reconciliation_status string, investigation_json string, amount double, "
        "currency string, confidence double",
    )
    row = audit.history_report(df).first()
    assert (row.root_cause, row.review_status, row.confidence) == ("-", "No review required", "50.0%")


REQUESTS = (
    "request_id int, draft string, audit_event_id string, invoice_id string, "
    "reconciliation_status string, reviewer_id string, environment string"
)


def test_one_open_review(spark):
    requests = spark.createDataFrame(
        [
            (1, " ", "e1", "A", "x", "r", "local"),
            (2, "d", "\t", "A", "x", "r", "local"),
            (3, "d", "e1", "", "x", "r", "local"),
            (4, " d ", " e1 ", " A ", None, "r", "local"),
            (5, "d", "e2", "A", "x", "q", "local"),
            (6, "d", "e3", "A", "x", "q", "prod"),
            (7, "d", "e4", "B", "x", "q", "local"),
        ],
        REQUESTS,
    )
    decided = approvals.decide(requests)
    got = {r.request_id: r.refused for r in decided.collect()}
    assert got == {
        1: "empty draft",
        2: "no audit event",
        3: "no invoice",
        4: None,
        5: "review already open",
        6: None,
        7: None,
    }
    events = approvals.approval_events(decided)
    assert events.columns == S.APPROVAL_EVENT.names
    first = events.filter("invoice_id = 'A' AND environment = 'local'").first()
    assert (first.final_draft, first.reconciliation_audit_event_id) == ("d", "e1")
    assert first.reconciliation_status == ""
    again = approvals.decide(requests, events).filter("refused IS NULL")
    assert again.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Three files, one a delivery seen before: the trail is the batch's result."""
    book = ledger(spark, *[record(invoice_id=f"A-{i}", vendor=f"V{i % 3}") for i in range(8)])
    rows = [
        record(invoice_id=f"A-{i % 8}", vendor=f"V{i % 8 % 3}", amount=1000.0 + (i % 4 == 3) * 50)
        for i in range(20)
    ]
    subs = submissions(spark, *rows)
    source = tmp_path / "in"
    for part, (low, high) in enumerate([(0, 7), (5, 12), (12, 20)]):
        piece = subs.filter(f"submission_id >= {low} AND submission_id < {high}")
        piece.coalesce(1).write.mode("append").parquet(f"{source}/part={part}")
    stream = (
        spark.readStream.schema(subs.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(str(source))
    )
    path, checkpoint = str(tmp_path / "trail"), str(tmp_path / "checkpoint")
    streams.reconcile_stream(stream, book, path, checkpoint, "run-1", reconcile).awaitTermination()
    trail = spark.read.parquet(path)
    assert trail.select("batch_id").distinct().count() == 3
    counts = {r.reconciliation_status: r["count"] for r in trail.groupBy("reconciliation_status").count().collect()}
    batch = settle(subs, book)
    want = {r.status: r["count"] for r in batch.groupBy("status").count().collect()}
    assert counts == want and trail.count() == 20
    # Whether the first one came in the same batch or earlier, a copy names its event.
    ids = {r.audit_event_id for r in trail.filter("reconciliation_status = 'matched'").collect()}
    copies = trail.filter("reconciliation_status = 'duplicate_charge'").collect()
    assert copies and {r.confidence for r in copies} == {1.0}
    assert {json.loads(r.discrepancy_details_json)["prior_audit_event_id"] for r in copies} <= ids
    assert audit.read_events(spark, path, "2020-01-01").count() == 20
    # A batch that runs again leaves the same rows.
    last = subs.filter("submission_id >= 12")
    streams.settle_batch(last, 2, book, path, "run-1")
    assert spark.read.parquet(path).count() == 20


def test_events_appended_once(spark, tmp_path):
    events = spark.range(50).select(F.col("id").cast("string").alias("audit_event_id"))
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    events.filter("audit_event_id < 5").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = str(tmp_path / "out")
    streams.append_once(stream, path, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(path).count() == 50


def test_tune_keeps_rules_the_owner_excluded(spark):
    key, before = "spark.sql.optimizer.excludedRules", spark.conf.get("spark.sql.optimizer.excludedRules", None)
    theirs = "org.apache.spark.sql.catalyst.optimizer.CombineUnions"
    try:
        spark.conf.set(key, theirs)
        tune(tune(spark))
        rules = spark.conf.get(key).split(",")
        assert theirs in rules and len(rules) == len(set(rules)) == 2
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

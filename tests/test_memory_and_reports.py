"""The stream's memory by buckets, identity over the whole ledger, reports of any shape."""

from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from tallyweave.operators.candidates import identity_counts
from tallyweave.sources import tables
from tallyweave.streaming.reconcile_stream import Memory, append_once, settle_batch, trail_memory
from tests.helpers import ledger, record, submissions


def test_a_batch_reads_the_buckets_of_its_own_keys(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "t"), "ids", "id", ["id", "n"], buckets=16)
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("n"), F.lit("wide").alias("other"))
    assert memory.before(rows, 0) is None
    for batch in range(3):
        memory.keep(rows.withColumn("n", F.col("n") + 1000 * batch), batch)
    asked = rows.where("n IN (7, 8)")
    found = memory.before(asked, 2)
    wanted = {r[0] for r in asked.select(memory.bucket()).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    read = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read} == wanted and not any("batch_id=2" in f for f in read)
    got = {(r["id"], r["n"]) for r in found.collect()}
    assert {("k7", 7), ("k7", 1007), ("k8", 8), ("k8", 1008)} <= got and len(got) < 400


def test_batches_know_what_earlier_ones_settled(spark, tmp_path):
    path, known = str(tmp_path / "trail"), ledger(spark, record(), record(invoice_id="INV-2"))
    settle_batch(submissions(spark, record()), 0, known, path, "run")
    again = submissions(spark, record(), record(invoice_id="INV-2")).withColumn("submission_id", F.col("submission_id") + 10)
    for _ in range(2):  # the second time as after a failure
        settle_batch(again, 1, known, path, "run")
    rows = spark.read.parquet(path).where("batch_id = 1").collect()
    assert {(r["invoice_id"], r["reconciliation_status"]) for r in rows} == {("INV-00001", "duplicate_charge"), ("INV-2", "matched")}
    # A trail without memory gets one from its events.
    (tmp_path / "old").mkdir()
    spark.read.parquet(path).write.partitionBy("batch_id").mode("overwrite").parquet(str(tmp_path / "old"))
    old = trail_memory(spark, str(tmp_path / "old"))
    assert old.before(again, 2).where("reconciliation_status = 'matched'").count() >= 2


def test_events_are_appended_once_across_runs(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.range(5 * k, 5 * k + 10).select(F.concat(F.lit("e"), "id").alias("audit_event_id")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("audit_event_id string").parquet(source)
        append_once(stream, path, str(tmp_path / "check")).awaitTermination()
    ids = [r["audit_event_id"] for r in spark.read.parquet(path).collect()]
    assert len(ids) == len(set(ids)) == 20


def test_identity_counts_all_vendors_once(spark):
    day, other = date(2026, 1, 15), date(2026, 2, 1)
    rows = [record(), record(vendor="Other"), record(invoice_id="INV-9"), record(invoice_id="INV-8", invoice_date=other)]
    rows += [record(invoice_id="", vendor="Blank"), record(invoice_id=None, vendor=None), record()]
    asked = [record(vendor="  ACME corp "), record(invoice_id=""), record(vendor="Nobody"), (None,) * 7, record(invoice_id="INV-8", invoice_date=day)]
    got = identity_counts(submissions(spark, *asked), ledger(spark, *rows)).orderBy("submission_id")
    assert [(r["same_id"], r["same_vendor_date"], r["same_identity"]) for r in got.collect()] == [
        (3, 3, 4), (0, 3, 3), (3, 0, 3), (0, 0, 0), (1, 3, 4),
    ]
    assert identity_counts(submissions(spark, *asked), ledger(spark)).agg(F.sum("same_identity")).first()[0] == 0


def test_reports_of_several_shapes_and_broken_lines(spark, tmp_path):
    lines = ['{"a": 1, "s": "x"}', '{"n": {"a": "2"}, "s": null}', "not json", "[1, 2]", '{"a": "word"}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    reports = tables.read_reports(spark, str(tmp_path))
    rows = reports.select(
        tables.report_field(["$.a", "$.n.a"], "bigint").alias("a"), tables.report_field(["$.s"], "string").alias("s"), "broken"
    ).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "x", None), (2, None, None), (None, None, "not json"), (None, None, None), (None, None, None)], key=str)


def test_a_batch_leaves_nothing_but_the_trail_and_its_memory(spark, tmp_path):
    folder, path = Path(spark.conf.get("spark.checkpoint.dir")), str(tmp_path / "trail")
    before = {p for p in folder.rglob("*") if p.is_file()}
    for k in range(2):
        settle_batch(submissions(spark, record(), record(invoice_id=f"INV-{k}")), k, ledger(spark, record()), path, f"run-{k}")
    assert {p for p in folder.rglob("*") if p.is_file()} == before
    assert spark.read.parquet(path).count() == 4

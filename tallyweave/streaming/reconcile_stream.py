"""Reconciling a stream of submissions into the audit trail.

Duplicates must be recognised for ever, so the memory of the stream is a table,
not a watermarked state store: narrow rows beside the trail, in folders by batch
and by hash of their key.  A batch reads the buckets of its own keys and nothing
else, however long the trail has grown.  Each micro-batch owns one folder of
either table and overwrites it, so a batch that is run again after a
failure leaves the same rows.  One writer per table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators.duplicates import (
    INVOICE_KEY,
    flag_known_invoices,
    flag_later_copies,
)
from tallyweave.operators.exceptions import draft_letters, investigate
from tallyweave.plans.reconcile import reconcile
from tallyweave.schemas import AUDIT_EVENT
from tallyweave.session import cut_lineage, passing, stored
from tallyweave.sources.audit import audit_events

#: What reading a table that no batch has written to yet fails with.
NOTHING_YET = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


#: What a batch needs to know of earlier events.
REMEMBERED = [*INVOICE_KEY, "audit_event_id", "event_timestamp", "run_id", "reconciliation_status"]


class Memory:
    """Some columns of the rows a stream has written, in folders by batch and bucket of a key."""

    def __init__(self, spark: SparkSession, path: str, name: str, key: str, columns: list[str], buckets: int = 64):
        # Readers of the table pass over folders that begin with an underscore.
        self.spark, self.path, self.table = spark, path, f"{path}/_{name}"
        self.key, self.columns, self.buckets = key, columns, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def before(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Rows of earlier batches in the buckets of this one's keys; nothing if no batch was written."""
        wanted = [r[0] for r in batch.select(self.bucket()).distinct().collect()]
        rows = self._read(self.table)
        if rows is None:
            # A table that an earlier version wrote has no memory yet.
            written = self._read(self.path)
            if written is None:
                return None
            self._write(written, self.table, ["batch_id", "bucket"])
            rows = self._read(self.table)
        return rows.where((F.col("batch_id") < batch_id) & F.col("bucket").isin(wanted)).select(*self.columns)

    def keep(self, batch: DataFrame, batch_id: int) -> None:
        self._write(batch, f"{self.table}/batch_id={batch_id}", ["bucket"])

    def _write(self, rows: DataFrame, path: str, folders: list[str]) -> None:
        kept = rows.withColumn("bucket", self.bucket())
        kept = kept.select(*dict.fromkeys([*self.columns, *folders]))
        kept.repartition("bucket").write.mode("overwrite").partitionBy(*folders).parquet(path)

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in NOTHING_YET:
                raise
            return None


def trail_memory(spark: SparkSession, path: str) -> Memory:
    """What a trail remembers of its invoices."""
    return Memory(spark, path, "memory", "invoice_id", REMEMBERED)


def settle_batch(
    batch: DataFrame,
    batch_id: int,
    ledger: DataFrame,
    path: str,
    run_id: str,
    decide: Callable[[DataFrame, DataFrame], DataFrame] = reconcile,
    event_time: Column | None = None,
) -> None:
    """Reconcile one micro-batch and write its audit events.

    Submissions that have an event already are left out, so a source may
    deliver a submission again.
    """
    spark = batch.sparkSession
    # All that a batch leaves is the trail and its memory.
    with passing(spark):
        fresh = batch.dropDuplicates(["submission_id"])
        results = stored(decide(fresh, ledger), "results")
        memory = trail_memory(spark, path)
        relevant = memory.before(results, batch_id)
        if relevant is None:
            relevant = spark.createDataFrame([], T.StructType([AUDIT_EVENT[c] for c in REMEMBERED]))
        known = flag_known_invoices(results, relevant)
        flagged = flag_later_copies(known, run_id=run_id, event_time=event_time)
        events = audit_events(draft_letters(investigate(flagged)), run_id, event_time)
        new = stored(events.join(relevant.select("audit_event_id"), "audit_event_id", "left_anti"), "events")
        memory.keep(new, batch_id)
        (
            new.withColumn("event_date", F.to_date("event_timestamp"))
            .write.mode("overwrite")
            .partitionBy("event_date")
            .parquet(f"{path}/batch_id={batch_id}")
        )


def reconcile_stream(
    submissions: DataFrame,
    ledger: DataFrame,
    path: str,
    checkpoint: str,
    run_id: str,
    decide: Callable[[DataFrame, DataFrame], DataFrame] = reconcile,
) -> StreamingQuery:
    """Start reconciling a stream; stops when the available input is done."""

    def settle(batch: DataFrame, batch_id: int) -> None:
        settle_batch(batch, batch_id, ledger, path, run_id, decide)

    return (
        submissions.writeStream.foreachBatch(settle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_once(
    events: DataFrame, path: str, checkpoint: str, id_col: str = "audit_event_id"
) -> StreamingQuery:
    """Append a stream of events, keeping one row per event id.

    Ids already in the table are left out, so replays and repeated deliveries
    change nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = cut_lineage(batch.dropDuplicates([id_col]))
        memory = Memory(spark, path, "ids", id_col, [id_col])
        known = memory.before(fresh, batch_id)
        if known is not None:
            fresh = cut_lineage(fresh.join(known, id_col, "left_anti"))
        memory.keep(fresh, batch_id)
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

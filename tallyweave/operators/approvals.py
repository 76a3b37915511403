"""Approving dispute drafts: one open review per invoice and environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.functions.text import strip
from tallyweave.operators.lookup import lookup


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def refusal() -> Column:
    """Why a request cannot be approved by itself, NULL if it can."""
    return (
        F.when(_blank(F.col("draft")), F.lit("empty draft"))
        .when(_blank(F.col("audit_event_id")), F.lit("no audit event"))
        .when(_blank(F.col("invoice_id")), F.lit("no invoice"))
    )


def open_reviews(approvals: DataFrame) -> DataFrame:
    """The latest open approval of each invoice and environment."""
    event = F.struct(
        "approval_event_id",
        "approved_at",
        "reviewer_id",
        "reconciliation_audit_event_id",
        "reconciliation_status",
    )
    return (
        approvals.filter(F.col("action") == S.OPEN_REVIEW_ACTION)
        .groupBy("invoice_id", "environment")
        .agg(F.max_by(event, F.struct("approved_at", "approval_event_id")).alias("review"))
    )


def decide(
    requests: DataFrame, approvals: DataFrame | None = None, order: str = "request_id"
) -> DataFrame:
    """Add ``refused``: NULL for the requests that open a review.

    Of several good requests for one invoice the first, by the unique
    ``order``, wins.  Who came first is found by aggregation, so a very
    popular invoice is no burden for a single task.
    """
    checked = requests.withColumns(
        {"refused": refusal(), "invoice_id": strip(F.col("invoice_id"))}
    )
    keys = ["invoice_id", "environment"]
    first = (
        checked.filter(F.col("refused").isNull())
        .groupBy(*keys)
        .agg(F.min(order).alias("_first"))
    )
    if approvals is not None:
        first = first.join(
            open_reviews(approvals).select(*keys, F.lit(True).alias("_open")), keys, "left"
        )
    else:
        first = first.withColumn("_open", F.lit(None).cast("boolean"))
    return (
        lookup(checked, first, keys)
        .withColumn(
            "refused",
            F.when(F.col("refused").isNotNull(), F.col("refused"))
            .when(F.col("_open"), F.lit("review already open"))
            .when(F.col(order) > F.col("_first"), F.lit("review already open")),
        )
        .drop("_first", "_open")
    )


def approval_events(decided: DataFrame, approved_at: Column | None = None) -> DataFrame:
    """Approval events of the requests that were not refused."""
    return decided.filter(F.col("refused").isNull()).select(
        F.sha2(
            F.concat_ws(":", strip(F.col("audit_event_id")), "invoice_id", "environment"), 256
        ).alias("approval_event_id"),
        (approved_at if approved_at is not None else F.current_timestamp()).alias("approved_at"),
        "reviewer_id",
        F.lit(S.OPEN_REVIEW_ACTION).alias("action"),
        strip(F.col("audit_event_id")).alias("reconciliation_audit_event_id"),
        "invoice_id",
        F.coalesce("reconciliation_status", F.lit("")).alias("reconciliation_status"),
        strip(F.col("draft")).alias("final_draft"),
        "environment",
    )


def append_approvals(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)

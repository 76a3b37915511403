"""Evaluation pipelines over labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.operators.classify import classify
from tallyweave.operators.duplicates import flag_later_copies
from tallyweave.operators.evaluation import stateless_expectation, stratified_split
from tallyweave.operators.extraction import extract_fields
from tallyweave.operators.retrieval import search_ledger
from tallyweave.operators.validation import field_matches
from tallyweave.plans.reconcile import reconcile, reconcile_by_id
from tallyweave.session import cut_lineage


def _cases(results: DataFrame) -> DataFrame:
    return results.select(
        "submission_id",
        "scenario",
        stateless_expectation(F.col("scenario")).alias("expected"),
        F.col("status").alias("predicted"),
        "confidence",
        "invoice_id",
    )


def rules_only(submissions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cases decided with the one ledger record of the case as candidate."""
    return _cases(reconcile_by_id(submissions, ledger))


def with_retrieval(submissions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cases decided on their true fields by a search of the whole ledger and the ladder: no id lookup, repair or promotion."""
    return _cases(classify(search_ledger(submissions, ledger, S.EVALUATION_TOP_K)))


def extracted_submissions(documents: DataFrame) -> DataFrame:
    """Submissions as read from their documents, absent fields as placeholders."""
    fields = extract_fields(documents)
    return fields.select(
        "submission_id",
        "scenario",
        *[
            F.col(n).cast("date").alias(n) if n == "invoice_date" else F.col(n)
            for n in S.RECORD_FIELDS
        ],
    )


def end_to_end(documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cases decided on fields read from the documents."""
    return _cases(reconcile(extracted_submissions(documents), ledger, S.EVALUATION_TOP_K, find=search_ledger))


def heldout(documents: DataFrame, ledger: DataFrame, truth: DataFrame) -> DataFrame:
    """End-to-end cases of the held-out split, with the duplicate rule.

    The invoices of duplicate-charge cases count as accepted beforehand.
    """
    split = stratified_split(documents.select("submission_id", "scenario"))
    chosen = split.filter(F.col("split") == "heldout").select("submission_id")
    cases = cut_lineage(end_to_end(documents.join(chosen, "submission_id"), ledger))
    seeds = truth.filter(F.col("scenario") == "duplicate_charge").join(chosen, "submission_id")
    flagged = flag_later_copies(
        cases.withColumnRenamed("predicted", "status"),
        keys=["invoice_id"],
        accepted=seeds,
    )
    return flagged.withColumn("expected", F.col("scenario")).withColumnRenamed(
        "status", "predicted"
    )


def extraction_checks(predicted: DataFrame, truth: DataFrame, with_fx: bool = True) -> DataFrame:
    """Per-field flags of predicted against true records, aligned by submission."""
    left = predicted.select(
        "submission_id", "scenario", *[F.col(n).alias(f"got_{n}") for n in S.RECORD_FIELDS]
    )
    right = truth.select("submission_id", *[F.col(n).alias(f"want_{n}") for n in S.RECORD_FIELDS])
    return left.join(right, "submission_id").withColumns(field_matches("got_", "want_", with_fx))

"""The registered queries: one per operator, each over whole tables.

Outputs are flat (dates and lists as text), so that any engine can compare
them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.catalog import inputs as I
from tallyweave.catalog.inputs import day
from tallyweave.functions import dates, money, text
from tallyweave.functions.records import text_of, vector_similarity
from tallyweave.operators import (
    approvals,
    candidates,
    cases,
    classify,
    duplicates,
    evaluation,
    exceptions,
    extraction,
    labeling,
    nearest,
    repair,
    spans,
    validation,
)
from tallyweave.operators.lookup import lookup
from tallyweave.plans import evaluate, reconcile
from tallyweave.session import shared_folder, tune
from tallyweave.sources import audit, tables
from tallyweave.sources import views as V
from tallyweave.streaming import reconcile_stream as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(tune(spark), folder)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _flat_record(df: DataFrame, *first: str) -> DataFrame:
    return df.select(
        *first, *[day(n).alias(n) if n == "invoice_date" else F.col(n) for n in S.RECORD_FIELDS]
    )


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for this run in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------


@query
def ledger_view(spark, folder):
    return _flat_record(V.ledger(spark, folder), "k")


@query
def ledger_scan(spark, folder):
    return _flat_record(tables.scan_ledger(V.ledger(spark, folder)))


@query
def ledger_scan_vendor(spark, folder):
    rows = tables.scan_ledger(V.ledger(spark, folder), "Customer#000000007", S.POOL_REPORT)
    return _flat_record(rows)


@query
def ledger_adhoc_sql(spark, folder):
    return tables.run_select(
        spark,
        """
        SELECT vendor, currency, count(*) AS invoices,
               sum(CAST(round(amount * 100) AS BIGINT)) AS cents
        FROM ledger WHERE amount >= :floor GROUP BY vendor, currency
        """,
        {"ledger": V.ledger(spark, folder)},
        {"floor": 1000.0},
    )


@query
def audit_events(spark, folder):
    results = reconcile.reconcile_by_id(*I.pair(spark, folder))
    return audit.audit_events(results, "run-1").select(
        "audit_event_id",
        "run_id",
        "invoice_id",
        day("invoice_date").alias("invoice_date"),
        "amount",
        "reconciliation_status",
        "confidence",
        "best_match_invoice_id",
        "discrepancy_details_json",
        "investigation_json",
        "dispute_letter_draft",
    )


@query
def audit_partitioned_scan(spark, folder):
    """Write the history by day, read one week of it back."""
    path = _scratch(spark, "audit")
    audit.append_events(I.event_history(spark, folder), path)
    return (
        audit.read_events(spark, path, "2024-01-03", "2024-01-09")
        .groupBy(day("event_date").alias("event_date"), "reconciliation_status")
        .agg(F.count("*").alias("events"))
    )


@query
def manifest_flatten(spark, folder):
    """Write a manifest as JSON, read it back as ledger rows."""
    path = _scratch(spark, "manifest")
    subs, ledger = I.pair(spark, folder)
    record = F.struct(
        *S.RECORD_FIELDS,
        F.array(
            F.struct(
                F.lit("Services").alias("description"),
                F.col("quantity").alias("qty"),
                F.lit(1.5).alias("price"),
            )
        ).alias("line_items"),
    )
    manifest = ledger.select(
        F.concat(F.lit("case-"), F.col("k").cast("string")).alias("case_id"),
        V.pick(F.col("k") % 7, V.SCENARIOS).alias("scenario"),
        F.concat(F.lit("page-"), F.col("k").cast("string")).alias("image_path"),
        record.alias("document_invoice"),
        record.alias("ledger_record"),
    )
    tables.write_report(manifest, path)
    rows = tables.manifest_rows(tables.read_manifest(spark, path))
    return _flat_record(rows, "case_id", "scenario", "line_items")


@query
def ledger_replace(spark, folder):
    """Replace a table twice, append to it once, count what it holds."""
    path = _scratch(spark, "ledger")
    ledger = tables.scan_ledger(V.ledger(spark, folder))
    tables.replace_table(ledger, path)
    tables.replace_table(ledger.filter("currency = 'EUR'"), path)
    tables.append_rows(ledger.filter("currency = 'USD'"), path)
    return spark.read.parquet(path).groupBy("currency").agg(F.count("*").alias("invoices"))


# --- predicates and projections ----------------------------------------------


@query
def record_coerce(spark, folder):
    typed = validation.coerce_records(I.raw_records(spark, folder))
    return typed.select(
        "submission_id",
        "invoice_date",
        "vendor",
        "amount",
        F.col("quantity").cast("double").alias("quantity"),
        "fx_rate",
        "rejected",
    )


@query
def validate_fields(spark, folder):
    return I.doubtful_records(spark, folder).select(
        "submission_id", *[c.alias(n) for n, c in validation.validation_flags().items()]
    )


@query
def split_complete(spark, folder):
    typed = validation.coerce_records(I.raw_records(spark, folder))
    return typed.select("submission_id", validation.completeness_route().alias("route"))


@query
def split_outcome(spark, folder):
    results = reconcile.reconcile_by_id(*I.pair(spark, folder))
    return results.select(
        "submission_id", validation.outcome_route(F.col("status")).alias("route")
    )


@query
def identity_predicate(spark, folder):
    """How many of all its vendor's ledger rows share a submission's identity."""
    subs, ledger = I.pair(spark, folder)
    rows = candidates.on_pages(subs, ledger).select(
        "submission_id",
        F.col("invoice_id").alias("sub_invoice_id"),
        F.col("vendor").alias("sub_vendor"),
        F.col("invoice_date").alias("sub_invoice_date"),
        F.explode("pool").alias("e"),
    )
    rows = rows.select("*", F.col("e.copies").alias("copies"))
    rows = rows.withColumns(
        {f"led_{n}": F.col(f"e.{n}") for n in ("invoice_id", "vendor", "invoice_date")}
    )
    return rows.groupBy("submission_id").agg(
        F.sum("copies").alias("candidates"),
        F.sum(F.when(validation.same_identity("sub_", "led_"), F.col("copies")).otherwise(0)).alias("same_identity"),
    )


def _checks(spark, folder, with_fx=True):
    return evaluate.extraction_checks(
        I.misread(spark, folder), V.submissions(spark, folder), with_fx
    )


FLAGS = [f"ok_{n}" for n in S.RECORD_FIELDS]


@query
def compare_fields(spark, folder):
    return _checks(spark, folder).select("submission_id", *FLAGS)


@query
def compare_doubtful(spark, folder):
    """Fields compared where every one of them is wrong, absent or written otherwise now and then."""
    key = I.order_key()
    vendor = F.col("vendor")
    read = I.doubtful_misread(spark, folder).withColumns(
        {
            "vendor": F.when(key % 9 == 0, F.concat(F.lit("  "), F.upper(vendor)))
            .when(key % 9 == 1, F.concat(vendor, F.lit("x")))
            .otherwise(vendor),
            "amount": F.when(key % 25 != 0, F.col("amount")),
        }
    )
    checks = evaluate.extraction_checks(read, V.submissions(spark, folder), True)
    return checks.select("submission_id", *FLAGS)


@query
def field_fallback(spark, folder):
    primary = I.doubtful_records(spark, folder)
    secondary = V.submissions(spark, folder).select(
        "submission_id",
        F.when(I.order_key() % 57 == 0, F.lit("??")).otherwise(F.col("vendor")).alias("vendor"),
        day("invoice_date").alias("invoice_date"),
        "amount",
    )
    filled = validation.with_fallback(primary, secondary, "submission_id")
    return filled.select(
        "submission_id",
        "vendor",
        "invoice_date",
        "amount",
        F.array_join("fallbacks.field", ",").alias("replaced"),
    )


# --- candidates --------------------------------------------------------------


@query
def match_exact_id(spark, folder):
    found = candidates.by_exact_id(*I.pair(spark, folder))
    return found.select(
        "submission_id",
        F.col("identity.invoice_id").alias("ledger_invoice_id"),
        F.col("identity.amount").alias("ledger_amount"),
    )


@query
def vendor_candidates(spark, folder):
    return candidates.vendor_candidates(*I.pair(spark, folder))


@query
def match_vendor_date(spark, folder):
    found = candidates.by_vendor_and_date(*I.pair(spark, folder))
    return found.select(
        "submission_id",
        F.col("weak_identity.invoice_id").alias("ledger_invoice_id"),
    )


@query
def match_identity(spark, folder):
    """Identity by id, else by vendor and date, on ids that often are lost."""
    subs, ledger = I.pair(spark, folder)
    lost = subs.withColumn(
        "invoice_id",
        F.when(I.order_key() % 3 == 0, F.lit(S.NO_INVOICE_ID)).otherwise(F.col("invoice_id")),
    )
    return candidates.by_identity(lost, ledger).select(
        "submission_id", F.col("identity.invoice_id").alias("ledger_invoice_id")
    )


def _neighbours(spark, folder, k=S.RUNTIME_TOP_K):
    vectors = V.table(spark, folder, "embeddings")
    return nearest.nearest_neighbours(vectors, vectors, k, exclude_self=True)


@query
def identity_counts(spark, folder):
    """How many of all ledger rows share a submission's identity, those of other vendors too."""
    subs, ledger = I.pair(spark, folder)
    # Some submissions name the id of another vendor's row.
    other = F.col("submission_id") % 10 == 0
    asked = subs.withColumn("vendor", F.when(other, F.lit("Someone else")).otherwise(F.concat(F.lit(" "), F.upper("vendor"))))
    return candidates.identity_counts(asked, ledger).select("submission_id", "same_id", "same_vendor_date", "same_identity")


@query
def report_read(spark, folder):
    """Case results written as reports of two shapes, read back without a schema and rolled up."""
    cases = evaluate.rules_only(*I.pair(spark, folder))
    flat = cases.select("submission_id", "expected", "predicted", "confidence")
    nested = flat.select(
        F.col("submission_id").cast("string").alias("case_id"),
        F.struct("expected", "predicted").alias("labels"),
        F.struct(F.col("confidence").alias("value")).alias("score"),
    )
    path = _scratch(spark, "reports")
    tables.write_report(flat.where("submission_id % 4 < 2"), f"{path}/flat")
    tables.write_report(nested.where("submission_id % 4 >= 2"), f"{path}/nested")
    reports = tables.read_reports(spark, f"{path}/*")
    read = reports.select(
        tables.report_field(["$.submission_id", "$.case_id"], "bigint").alias("case_id"),
        tables.report_field(["$.expected", "$.labels.expected"], "string").alias("expected"),
        tables.report_field(["$.predicted", "$.labels.predicted"], "string").alias("predicted"),
        tables.report_field(["$.confidence", "$.score.value"], "double").alias("confidence"),
    )
    return read.groupBy("expected").agg(
        F.count("case_id").alias("cases"),
        F.count_if(F.col("expected") == F.col("predicted")).alias("correct"),
        F.min("case_id").alias("first_case"),
        F.min("confidence").alias("least_confidence"),
    )


@query
def knn_topk(spark, folder):
    """The three nearest vectors of every vector, over the whole pool."""
    return _neighbours(spark, folder)


@query
def knn_vendor_pool(spark, folder):
    """Vector search within the vendor's pool, for ledgers that come with vectors."""
    vectors = V.table(spark, folder, "embeddings")
    size = vectors.count()

    def with_vector(df: DataFrame, number: Column) -> DataFrame:
        return df.withColumn("vec_id", number % size).join(
            vectors.select("vec_id", "embedding"), "vec_id"
        )

    subs, ledger = I.pair(spark, folder)
    found = candidates.search(
        with_vector(subs, I.order_key() + 1),
        with_vector(ledger, F.col("k")).drop("vec_id"),
        S.RUNTIME_TOP_K,
        features=lambda prefix: F.col("embedding"),
        similarity=vector_similarity,
    )
    return candidates.candidate_rows(found).select(
        "submission_id", "pos", "semantic_score", "ledger_invoice_id"
    )


@query
def ambiguity_gap(spark, folder):
    """Gap between the two best neighbours of every vector."""
    top = _neighbours(spark, folder, 2)
    return (
        top.groupBy("query_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"),
            F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        )
        .select(
            "query_id",
            "best",
            "second",
            F.round(F.col("best") - F.col("second"), 4).alias("gap"),
            (F.round(F.col("best") - F.col("second"), 4) < S.AMBIGUITY_MARGIN).alias("ambiguous"),
        )
    )


def _retrieved(spark, folder):
    subs, ledger = I.misread(spark, folder), V.ledger(spark, folder)
    return candidates.search(candidates.by_exact_id(subs, ledger), ledger)


@query
def candidate_report(spark, folder):
    rows = candidates.candidate_rows(_retrieved(spark, folder))
    return rows.select(
        "submission_id",
        "rank",
        "semantic_score",
        "ledger_invoice_id",
        "ledger_vendor",
        money.money_text(F.col("ledger_amount"), F.col("ledger_currency")).alias("ledger_total"),
    )


@query
def promote_identity(spark, folder):
    promoted = candidates.promote_identity(_retrieved(spark, folder))
    return candidates.candidate_rows(promoted).select(
        "submission_id", "pos", "rank", "semantic_score", "ledger_invoice_id"
    )


@query
def candidates_nested(spark, folder):
    rows = candidates.candidate_rows(candidates.promote_identity(_retrieved(spark, folder)))
    nested = candidates.nest_candidates(rows)
    return nested.select(
        "submission_id",
        F.size("candidates").alias("n"),
        F.array_join("candidates.ledger_record.invoice_id", ",").alias("ledger_invoice_ids"),
    )


@query
def record_text(spark, folder):
    return V.submissions(spark, folder).select("submission_id", text_of().alias("record_text"))


# --- repair, ladder, duplicates ----------------------------------------------


@query
def ledger_repair(spark, folder):
    found = candidates.by_exact_id(I.misread(spark, folder), V.ledger(spark, folder))
    fixed = repair.repair_fields(found)
    return fixed.select(
        "submission_id",
        "amount",
        "quantity",
        F.array_join("repairs.field", ",").alias("repaired"),
    )


def _decided(df: DataFrame) -> DataFrame:
    return df.select(
        "submission_id",
        "scenario",
        "status",
        "confidence",
        F.col("best_match.invoice_id").alias("best_match_invoice_id"),
    )


@query
def classify_rules(spark, folder):
    return _decided(reconcile.reconcile_by_id(*I.pair(spark, folder)))


@query
def reconcile_submissions(spark, folder):
    """The whole matcher on misread submissions."""
    results = reconcile.reconcile(I.misread(spark, folder), V.ledger(spark, folder))
    return _decided(results)


@query
def reconcile_doubtful(spark, folder):
    """The whole matcher where ids, dates and more are wrong: every rule of the ladder decides rows."""
    results = reconcile.reconcile(I.doubtful_misread(spark, folder), V.ledger(spark, folder))
    return _decided(results)


@query
def duplicate_lookup(spark, folder):
    known = duplicates.latest_success(I.event_history(spark, folder), ["invoice_id", "vendor"])
    return known.select(
        F.col("_key_invoice_id").alias("invoice_id"),
        F.col("_key_vendor").alias("vendor"),
        F.col("prior.audit_event_id").alias("audit_event_id"),
        F.col("prior.run_id").alias("run_id"),
    )


@query
def detect_duplicates(spark, folder):
    results = reconcile.reconcile_by_id(*I.pair(spark, folder))
    flagged = duplicates.flag_known_invoices(results, I.ledger_history(spark, folder))
    return flagged.select(
        "submission_id",
        "status",
        "confidence",
        F.col("details.prior_audit_event_id").alias("prior_audit_event_id"),
    )


@query
def sequential_duplicates(spark, folder):
    results = reconcile.reconcile_by_id(*I.pair(spark, folder))
    return duplicates.flag_later_copies(results).select("submission_id", "scenario", "status")


# --- exceptions, audit, approvals --------------------------------------------


def _explained(spark, folder):
    results = duplicates.flag_later_copies(reconcile.reconcile_by_id(*I.pair(spark, folder)))
    return exceptions.investigate(results)


@query
def investigate(spark, folder):
    return _explained(spark, folder).select(
        "submission_id",
        "root_cause",
        "severity",
        "summary",
        "recommended_action",
        "dispute_reason",
    )


@query
def draft_letters(spark, folder):
    letters = exceptions.draft_letters(_explained(spark, folder))
    return letters.select("submission_id", "dispute_draft")


@query
def exception_queue(spark, folder):
    queue = exceptions.exception_queue(reconcile.reconcile_by_id(*I.pair(spark, folder)))
    return queue.select(
        "submission_id",
        F.col("invoice.invoice_id").alias("invoice_id"),
        "status",
        "confidence",
        classify.details_json(F.col("details")).alias("details"),
    )


@query
def review_history(spark, folder):
    history = audit.list_history(
        I.event_history(spark, folder), root_cause="amount_mismatch", severity="high"
    )
    report = audit.history_report(history)
    return report.withColumn(
        "event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss")
    )


@query
def json_filter(spark, folder):
    """Events whose JSON holds a given value."""
    number = F.get_json_object("props", "$.k")
    return (
        V.table(spark, folder, "events")
        .filter(number.isin("7", "42", "69"))
        .select("event_id", number.alias("k"))
    )


@query
def open_review_gate(spark, folder):
    reviews = approvals.open_reviews(I.event_approvals(spark, folder))
    return reviews.select(
        "invoice_id",
        "environment",
        F.col("review.approval_event_id").alias("approval_event_id"),
        F.col("review.reviewer_id").alias("reviewer_id"),
    )


@query
def approve_drafts(spark, folder):
    decided = reconcile.reconcile_by_id(*I.pair(spark, folder))
    requests = I.approval_requests(decided)
    return approvals.decide(requests, I.event_approvals(spark, folder)).select(
        "request_id", "invoice_id", F.coalesce("refused", F.lit("approved")).alias("outcome")
    )


@query
def approval_log(spark, folder):
    """Approvals appended to a table, read back, and every request made again."""
    path = _scratch(spark, "approvals")
    requests = I.approval_requests(reconcile.reconcile_by_id(*I.pair(spark, folder)))
    log = I.event_approvals(spark, folder)
    approvals.append_approvals(log, path)
    first = approvals.decide(requests, spark.read.schema(log.schema).parquet(path))
    approvals.append_approvals(
        approvals.approval_events(first, F.to_timestamp(F.lit("2030-01-01 00:00:00"))).select(log.columns), path
    )
    again = approvals.decide(requests, spark.read.schema(log.schema).parquet(path))
    return again.select(
        "request_id", "invoice_id", F.coalesce("refused", F.lit("approved")).alias("outcome")
    )


# --- scoring -----------------------------------------------------------------


def _rule_cases(spark, folder):
    return evaluate.rules_only(*I.pair(spark, folder))


def _neighbour_cases(spark, folder):
    """The label of a vector against the label of its nearest neighbour."""
    labels = V.table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label")
    )
    best = _neighbours(spark, folder, 1)
    return best.join(
        labels.withColumnsRenamed({"vec_id": "query_id", "label": "expected"}), "query_id"
    ).join(labels.withColumnsRenamed({"vec_id": "neighbour_id", "label": "predicted"}), "neighbour_id")


@query
def accuracy(spark, folder):
    return evaluation.accuracy(_neighbour_cases(spark, folder))


@query
def class_report(spark, folder):
    return evaluation.class_report(_neighbour_cases(spark, folder))


@query
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(
        _neighbour_cases(spark, folder), [str(n) for n in range(10)]
    )


@query
def label_universe(spark, folder):
    return evaluation.label_universe(_rule_cases(spark, folder))


@query
def field_accuracy(spark, folder):
    scored = evaluation.field_accuracy(_checks(spark, folder), FLAGS)
    return scored.drop("all_fields_exact_accuracy")


@query
def all_fields_accuracy(spark, folder):
    scored = evaluation.field_accuracy(_checks(spark, folder), FLAGS)
    return scored.select("total_cases", "all_fields_exact_accuracy")


@query
def repair_lift(spark, folder):
    """Field accuracy before and after repair, side by side in one pass."""
    truth = V.submissions(spark, folder)
    found = candidates.by_exact_id(I.misread(spark, folder), V.ledger(spark, folder))
    before = {f"before_{n}": F.col(n) for n in S.RECORD_FIELDS}
    fixed = repair.repair_fields(found.withColumns(before))
    want = truth.select("submission_id", *[F.col(n).alias(f"want_{n}") for n in S.RECORD_FIELDS])
    joined = fixed.withColumnsRenamed({n: f"after_{n}" for n in S.RECORD_FIELDS}).join(
        want, "submission_id"
    )
    flags = {
        **validation.field_matches("before_", "want_", False, "was_"),
        **validation.field_matches("after_", "want_", False, "now_"),
    }
    checked = joined.withColumns(flags)
    names = [n for n in S.RECORD_FIELDS if n != "fx_rate"]

    def share(flag: Column) -> Column:
        return F.round(F.avg(flag.cast("double")), 4)

    def every(prefix: str) -> Column:
        held = F.lit(True)
        for n in names:
            held = held & F.col(prefix + n)
        return held

    return checked.agg(
        F.count("*").alias("total_cases"),
        share(every("was_")).alias("before_all_fields"),
        share(every("now_")).alias("after_all_fields"),
        *[share(F.col(f"was_{n}")).alias(f"before_{n}") for n in names],
        *[share(F.col(f"now_{n}")).alias(f"after_{n}") for n in names],
    )


@query
def error_summary(spark, folder):
    return evaluation.error_summary(_checks(spark, folder), FLAGS)


@query
def failed_cases(spark, folder):
    failed = evaluation.failed_cases(_checks(spark, folder), FLAGS)
    return failed.select(
        "submission_id", "scenario", F.array_join("incorrect_fields", ",").alias("incorrect_fields")
    )


@query
def scenario_counts(spark, folder):
    return evaluation.distribution(V.submissions(spark, folder), "scenario")


@query
def worst_cases(spark, folder):
    wrong = evaluation.worst_cases(
        _neighbour_cases(spark, folder).select(
            F.col("query_id").alias("submission_id"),
            "expected",
            "predicted",
            F.col("score").alias("confidence"),
        )
    )
    return wrong.select("submission_id", "expected", "predicted", "confidence")


@query
def stratified_split(spark, folder):
    return evaluation.stratified_split(V.submissions(spark, folder)).select(
        "submission_id", "scenario", "split"
    )


@query
def split_distribution(spark, folder):
    split = evaluation.stratified_split(V.submissions(spark, folder))
    return evaluation.distribution(split, "split", "scenario")


@query
def metrics_rollup(spark, folder):
    """Extraction and reconciliation figures in one row."""
    checks = evaluation.field_accuracy(_checks(spark, folder), FLAGS).select(
        F.col("total_cases").alias("extraction_cases"), "all_fields_exact_accuracy"
    )
    scored = evaluation.accuracy(_rule_cases(spark, folder)).select(
        F.col("total_cases").alias("reconciliation_cases"), "accuracy"
    )
    return checks.join(scored, F.lit(True))


# --- evaluation pipelines ----------------------------------------------------


@query
def eval_rules(spark, folder):
    return evaluation.class_report(_rule_cases(spark, folder))


@query
def eval_retrieval(spark, folder):
    return evaluation.class_report(evaluate.with_retrieval(*I.pair(spark, folder)))


@query
def eval_end_to_end(spark, folder):
    cases_ = evaluate.end_to_end(I.documents(spark, folder), V.ledger(spark, folder))
    return evaluation.confusion_matrix(cases_, S.STATUSES)


@query
def eval_heldout(spark, folder):
    cases_ = evaluate.heldout(
        I.documents(spark, folder), V.ledger(spark, folder), V.submissions(spark, folder)
    )
    return evaluation.class_report(cases_, S.HELDOUT_LABELS)


@query
def eval_combined(spark, folder):
    predicted = evaluate.extracted_submissions(I.documents(spark, folder))
    checks = evaluate.extraction_checks(predicted, V.submissions(spark, folder))
    fields = evaluation.field_accuracy(checks, FLAGS).select(
        F.col("total_cases").alias("extraction_cases"), "all_fields_exact_accuracy"
    )
    scored = evaluation.accuracy(evaluate.with_retrieval(*I.pair(spark, folder)))
    return fields.join(scored, F.lit(True))


# --- text functions ----------------------------------------------------------


def _documents(spark, folder):
    return V.spread_table(spark, folder, "documents", "doc_id", "text")


@query
def norm_text(spark, folder):
    return _documents(spark, folder).select("doc_id", text.norm_text(F.col("text")).alias("norm"))


@query
def norm_alnum(spark, folder):
    return _documents(spark, folder).select("doc_id", text.norm_alnum(F.col("text")).alias("norm"))


@query
def parse_amount(spark, folder):
    return I.noisy_values(spark, folder).select(
        "k", money.parse_amount(F.col("amount_text")).alias("amount")
    )


@query
def last_amount(spark, folder):
    return I.noisy_values(spark, folder).select(
        "k", money.last_amount(F.col("total_text")).alias("amount")
    )


@query
def norm_numeric(spark, folder):
    return I.noisy_values(spark, folder).select(
        "k", money.norm_numeric(F.col("amount_text")).alias("numeric_text")
    )


@query
def detect_currency(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", extraction.detect_currency(F.col("text")).alias("currency")
    )


@query
def norm_currency(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", extraction.norm_currency(F.col("text")).alias("currency")
    )


@query
def parse_dates(spark, folder):
    value = F.col("date_text")
    return I.noisy_values(spark, folder).select(
        "k",
        day(dates.parse_date(value)).alias("numeric_first"),
        day(dates.parse_date(value, names_first=True)).alias("names_first"),
    )


@query
def extract_date(spark, folder):
    return I.noisy_values(spark, folder).select(
        "k", day(dates.extract_date(F.col("date_text"))).alias("invoice_date")
    )


@query
def extract_invoice_id(spark, folder):
    return I.documents(spark, folder).select(
        "submission_id", extraction.extract_invoice_id(F.col("text")).alias("invoice_id")
    )


@query
def extract_vendor(spark, folder):
    """Vendors of the invoices, every other one with its header line lost."""
    lines = F.when(I.order_key() % 2 == 0, F.col("lines")).otherwise(
        F.slice("lines", 2, 20)
    )
    return I.documents(spark, folder).select(
        "submission_id",
        F.coalesce(extraction.extract_vendor(lines), F.lit(S.NO_VENDOR)).alias("vendor"),
    )


@query
def extract_total(spark, folder):
    """Totals of the invoices; every third one lost the line that names it."""
    docs = I.documents(spark, folder).withColumn(
        "lines",
        F.when(I.order_key() % 3 == 0, F.slice("lines", 1, 10)).otherwise(F.col("lines")),
    )
    return extraction.with_total(docs).select("submission_id", "amount")


@query
def extract_quantity(spark, folder):
    """Quantities of the invoices; every fourth one lost its table header."""
    lines = F.when(
        I.order_key() % 4 == 0, F.filter("lines", lambda v: ~v.startswith("Description"))
    ).otherwise(F.col("lines"))
    return I.documents(spark, folder).select(
        "submission_id",
        F.coalesce(extraction.extract_quantity(lines), F.lit(1)).alias("quantity"),
    )


@query
def extract_fx_rate(spark, folder):
    return I.documents(spark, folder).select(
        "submission_id", extraction.extract_fx_rate(F.col("lines")).alias("fx_rate")
    )


@query
def extract_fields(spark, folder):
    return _flat_record(
        evaluate.extracted_submissions(I.documents(spark, folder)), "submission_id"
    )


@query
def chunk_words(spark, folder):
    lines = extraction.chunk_words(I.words_of(F.col("text")))
    return _documents(spark, folder).select("doc_id", F.posexplode(lines).alias("n", "line"))


@query
def assemble_lines(spark, folder):
    return extraction.assemble_lines(I.tokens(spark, folder))


@query
def doc_text(spark, folder):
    return extraction.documents_from_tokens(I.tokens(spark, folder)).select(
        "doc_id", "text", "n_words"
    )


@query
def doc_confidence(spark, folder):
    return extraction.documents_from_tokens(I.tokens(spark, folder)).select(
        "doc_id", "n_words", "mean_confidence"
    )


def _boxed(spark, folder):
    """A box per line item: quantity, price and size as pixel coordinates."""
    return V.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.array(
            (F.col("l_partkey") % 700).cast("int"),
            (F.col("l_suppkey") % 900).cast("int"),
            (F.col("l_orderkey") % 800).cast("int"),
            (F.col("l_quantity") * 20).cast("int"),
        ).alias("box"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(0)).otherwise(F.lit(640)).alias("width"),
        F.lit(960).alias("height"),
    )


@query
def normalize_boxes(spark, folder):
    boxes = _boxed(spark, folder).withColumn(
        "norm", extraction.normalize_box(F.col("box"), F.col("width"), F.col("height"))
    )
    return boxes.groupBy(F.coalesce(F.array_join("norm", ","), F.lit("rejected")).alias("norm")).agg(
        F.count("*").alias("boxes")
    )


# --- token labels ------------------------------------------------------------


@query
def token_checks(spark, folder):
    """Samples with as many boxes as words, and those without."""
    docs = _documents(spark, folder)
    words = I.words_of(F.col("text"))
    spare = F.when(F.col("doc_id") % 5 == 0, F.lit(1)).otherwise(F.lit(0))
    box = F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    samples = docs.select(
        "doc_id",
        words.alias("words"),
        F.array_repeat(box, (F.size(words) + spare).cast("int")).alias("bboxes"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(0)).otherwise(F.lit(100)).alias("width"),
        F.lit(100).alias("height"),
    )
    return labeling.check_samples(samples).select("doc_id", "accepted")


@query
def fuzzy_vendor_match(spark, folder):
    """Lines of an invoice that resemble its vendor's name, read with errors."""
    docs = I.documents(spark, folder).select("submission_id", "lines")
    names = V.submissions(spark, folder).select(
        "submission_id", F.translate("vendor", "so", "50").alias("company")
    )
    flagged = labeling.with_vendor_flags(docs.join(names, "submission_id"), words="lines")
    return flagged.select(
        "submission_id",
        F.size(F.filter("is_vendor", lambda v: v)).alias("matching_lines"),
        F.get("is_vendor", F.lit(0)).alias("header_matches"),
    )


@query
def bio_labels(spark, folder):
    labelled = labeling.assign_labels(I.entity_documents(spark, folder))
    return labelled.select(
        "submission_id",
        F.array_join("labels", " ").alias("labels"),
        F.array_join(F.transform("labels", labeling.label_id), " ").alias("label_ids"),
    )


@query
def bio_spans(spark, folder):
    spans = labeling.with_spans(I.labelled_documents(spark, folder))
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@query
def first_subtoken(spark, folder):
    """Words cut into pieces of four characters; the first piece's label counts."""
    words = I.labelled_documents(spark, folder).select(
        "doc_id", F.posexplode(F.arrays_zip("words", "labels", "scores")).alias("word", "w")
    )
    pieces = words.filter(F.col("word") % 9 != 0).select(
        "doc_id",
        "word",
        F.posexplode(
            F.sequence(F.lit(1), F.greatest(F.length("w.words"), F.lit(1)), F.lit(4))
        ).alias("piece", "start"),
        F.col("w.labels").alias("label"),
        F.col("w.scores").alias("score"),
    )
    subtokens = pieces.select(
        "doc_id",
        "word",
        F.col("piece").alias("tok"),
        F.when(F.col("piece") == 0, F.col("label")).otherwise(F.lit("I-DATE")).alias("label"),
        (F.col("score") / (F.col("piece") + 1)).alias("score"),
    )
    return labeling.first_subtokens(subtokens, words.select("doc_id", "word"))


@query
def training_labels(spark, folder):
    """Label ids of subtokens: later pieces of a word are ignored."""
    docs = I.labelled_documents(spark, folder)
    pieces = F.flatten(
        F.transform(
            "words",
            lambda w, i: F.array_repeat(i, F.ceil(F.length(w) / 4).cast("int")),
        )
    )
    ids = F.transform("labels", labeling.label_id)
    labels = labeling.training_labels(F.col("pieces"), F.col("ids"))
    return docs.withColumns({"pieces": pieces, "ids": ids}).select(
        "doc_id", F.array_join(labels, " ").alias("label_ids")
    )


@query
def label_distribution(spark, folder):
    return labeling.label_counts(I.labelled_documents(spark, folder))


@query
def entity_coverage(spark, folder):
    return labeling.entity_coverage(I.labelled_documents(spark, folder))


@query
def class_weights(spark, folder):
    """Weights of the token labels, every thirteenth word being ignored."""
    docs = I.labelled_documents(spark, folder)
    ids = F.transform(
        "labels",
        lambda v, i: F.when(i % 13 == 0, F.lit(S.IGNORED_LABEL_ID)).otherwise(
            labeling.label_id(v)
        ),
    )
    return labeling.class_weights(docs.withColumn("ids", ids), "ids")


@query
def missing_label_rates(spark, folder):
    rates, _ = labeling.documents_without(I.labelled_documents(spark, folder), "TOTAL")
    return rates


@query
def missing_label_docs(spark, folder):
    _, samples = labeling.documents_without(I.labelled_documents(spark, folder), "DATE")
    return samples.select(
        "split", "doc_id", "nth", F.array_join("digit_words", " ").alias("digit_words")
    )


@query
def o_ratio(spark, folder):
    docs = I.labelled_documents(spark, folder)
    return (
        labeling.o_share(docs, "predicted")
        .withColumnsRenamed({"o_ratio": "predicted_o_ratio"})
        .join(
            labeling.o_share(docs, "labels").select(F.col("o_ratio").alias("true_o_ratio")),
            F.lit(True),
        )
    )


@query
def span_metrics(spark, folder):
    docs = I.labelled_documents(spark, folder)
    both = labeling.with_spans(
        labeling.with_spans(docs, out="true_spans"), labels="predicted", out="predicted_spans"
    )
    return labeling.span_metrics(both)


@query
def token_accuracy(spark, folder):
    return labeling.token_accuracy(I.labelled_documents(spark, folder), "predicted", "labels")


@query
def best_label(spark, folder):
    """Index of the largest component of every vector."""
    return V.table(spark, folder, "embeddings").select(
        "vec_id", labeling.best_label(F.col("embedding")).alias("best")
    )


@query
def best_spans(spark, folder):
    """The best span of each type, and their mean score."""
    docs = I.labelled_documents(spark, folder)
    found = labeling.with_spans(docs)
    best = found.select(
        "doc_id",
        F.array_join("words", " ").alias("raw"),
        *[labeling.best_span(F.col("spans"), kind).alias(kind) for kind in S.ENTITY_TYPES],
    )
    return best.select(
        "doc_id",
        F.coalesce("VENDOR.text", F.lit(S.NO_VENDOR)).alias("vendor"),
        F.coalesce("DATE.text", F.lit("")).alias("date_text"),
        F.coalesce("TOTAL.text", F.lit("")).alias("total_text"),
        extraction.norm_currency(F.coalesce("TOTAL.text", "raw")).alias("currency"),
        spans.overall_confidence([F.col(kind) for kind in S.ENTITY_TYPES]).alias("overall_confidence"),
    )


@query
def span_records(spark, folder):
    """Spans of documents in many ways of writing, as invoice records."""
    docs = labeling.with_spans(I.span_documents(spark, folder))
    records = spans.span_records(docs, ["k"])
    return records.withColumn("invoice_date", day("invoice_date"))


# --- cases -------------------------------------------------------------------


@query
def document_variants(spark, folder):
    return _flat_record(
        V.document_variants(V.ledger(spark, folder)), "submission_id", "scenario"
    )


@query
def inject_discrepancies(spark, folder):
    return _flat_record(cases.inject_discrepancies(V.ledger(spark, folder)), "k", "origin")


@query
def balanced_cases(spark, folder):
    return cases.balanced_cases(V.submissions(spark, folder)).select(
        "case_id", "scenario", "submission_id"
    )


@query
def line_items_explode(spark, folder):
    unified = cases.unify_items(I.ledger_with_items(spark, folder))
    return unified.select("k", F.posexplode("items").alias("n", "i")).select("k", "n", "i.*")


@query
def line_item_totals(spark, folder):
    unified = cases.unify_items(I.ledger_with_items(spark, folder))
    return unified.select(
        "k",
        F.size("items").alias("items"),
        cases.items_total(F.col("items"), F.col("fx_rate")).alias("items_total"),
        "amount",
    )


# --- streaming ---------------------------------------------------------------


def _stream(spark, folder, name):
    """A given table as a stream of its files."""
    return (
        spark.readStream.schema(V.table(spark, folder, name).schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(folder)
    )


def _order_stream(spark, folder):
    """Submissions as they come, built from the stream of orders."""
    orders = _stream(spark, folder, "orders")
    known = V.submissions(spark, folder).withColumn("o_orderkey", I.order_key())
    return orders.select("o_orderkey").join(known, "o_orderkey").drop("o_orderkey")


@query
def stream_reconcile(spark, folder):
    """Submissions streamed into the audit trail; the trail's statuses."""
    path, checkpoint = _scratch(spark, "trail"), _scratch(spark, "stream")
    running = streams.reconcile_stream(
        _order_stream(spark, folder),
        V.ledger(spark, folder),
        path,
        checkpoint,
        "run-1",
        reconcile.reconcile_by_id,
    )
    running.awaitTermination()
    return (
        spark.read.parquet(path)
        .groupBy("reconciliation_status")
        .agg(F.count("*").alias("events"))
    )


@query
def stream_settle(spark, folder):
    """Misread submissions through the whole matcher in several micro-batches; the trail's statuses.

    Copies of an invoice mostly come in different micro-batches.
    """
    arrivals, book, path, checkpoint = (_scratch(spark, n) for n in ("arrivals", "ledger", "trail", "stream"))
    files = spark.sparkContext.defaultParallelism
    submitted = I.misread(spark, folder)
    submitted.repartition(files, "submission_id").write.parquet(arrivals)
    # Every micro-batch reads the ledger, so it is built once.
    V.ledger(spark, folder).write.parquet(book)
    stream = (
        spark.readStream.schema(submitted.schema)
        .option("maxFilesPerTrigger", max(1, -(-files // 2)))
        .parquet(arrivals)
    )
    ledger = spark.read.parquet(book)
    streams.reconcile_stream(stream, ledger, path, checkpoint, "run-1").awaitTermination()
    return (
        audit.read_events(spark, path, "1970-01-01")
        .groupBy("reconciliation_status")
        .agg(F.count("*").alias("events"))
    )


@query
def stream_audit_dedupe(spark, folder):
    """Events streamed twice over into a table that keeps each id once."""
    path, checkpoint = _scratch(spark, "events"), _scratch(spark, "stream")
    doubled = _stream(spark, folder, "events").withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("event_id").alias("audit_event_id"), "event_type", "value"
    )
    streams.append_once(doubled, path, checkpoint).awaitTermination()
    return (
        spark.read.parquet(path)
        .groupBy("event_type")
        .agg(F.count("*").alias("events"), F.count_distinct("audit_event_id").alias("ids"))
    )

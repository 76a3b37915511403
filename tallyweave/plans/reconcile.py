"""Whole pipelines: from submissions and a ledger to decided, explained rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.operators.candidates import by_exact_id, identity_only, promote_identity, search
from tallyweave.operators.classify import classify
from tallyweave.operators.duplicates import flag_known_invoices, flag_later_copies
from tallyweave.operators.exceptions import draft_letters, investigate
from tallyweave.operators.repair import repair_fields
from tallyweave.operators.validation import is_complete
from tallyweave.session import cut_lineage


def reconcile(
    submissions: DataFrame,
    ledger: DataFrame,
    top_k: int = S.RUNTIME_TOP_K,
    threshold: float = S.MATCH_THRESHOLD,
    find: Callable[[DataFrame, DataFrame, int], DataFrame] = search,
) -> DataFrame:
    """Decide every submission against the ledger.

    Exact id first, then repair from that record, then similarity, then the
    ladder.  ``find`` adds the similar records: ``candidates.search`` those of the
    vendor, ``retrieval.search_ledger`` those of the whole ledger.
    """
    found = by_exact_id(submissions, ledger)
    identified = repair_fields(
        found.withColumn("identity", F.when(is_complete(), F.col("identity")))
    )
    searched = find(identified, ledger, top_k)
    return classify(promote_identity(searched), threshold=threshold)


def reconcile_by_id(submissions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Decide with nothing but the exact-id record as candidate."""
    return classify(identity_only(by_exact_id(submissions, ledger)))


def settle(
    submissions: DataFrame,
    ledger: DataFrame,
    audit: DataFrame | None = None,
    top_k: int = S.RUNTIME_TOP_K,
    run_id: str | None = None,
) -> DataFrame:
    """Reconcile, flag duplicates, explain exceptions and draft letters.

    ``audit`` is the history so far; what it knows counts before copies within
    the batch do.  ``run_id``, if given, lets those name the first one's event.
    """
    results = cut_lineage(reconcile(submissions, ledger, top_k))
    if audit is not None:
        results = flag_known_invoices(results, audit)
    return draft_letters(investigate(flag_later_copies(results, run_id=run_id)))

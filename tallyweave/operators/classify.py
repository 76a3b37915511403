"""The reconciliation ladder: the first rule that applies decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.functions.arrays import let
from tallyweave.functions.text import strip
from tallyweave.operators.validation import is_complete, relative_difference


_NO_DETAILS = "named_struct({})".format(
    ", ".join(f"'{name}', CAST(NULL AS {kind})" for name, kind in S.DETAIL_FIELDS.items())
)


def details(**values: Column) -> Column:
    """The wide details struct with only the given keys filled."""
    filled = F.expr(_NO_DETAILS)
    for name, value in values.items():
        filled = filled.withField(name, value.cast(S.DETAIL_FIELDS[name]))
    return filled


def details_json(c: Column) -> Column:
    """Sorted-key JSON of the filled details; NULL details are an empty object."""
    return F.coalesce(F.to_json(c), F.lit("{}"))


def classify(
    df: DataFrame,
    threshold: float = S.MATCH_THRESHOLD,
    margin: float = S.AMBIGUITY_MARGIN,
    identity_overrides_threshold: bool = False,
) -> DataFrame:
    """Add ``status``, ``confidence``, ``best_match`` and ``details``.

    Reads the record fields and ``candidates`` (best first).  A row that lacks
    a field is unmatched, whatever its candidates.  A promoted record can score
    below the threshold; ``identity_overrides_threshold`` lets its verified
    identity outweigh that.

    The candidates are mentioned once: a filter on the status, which the
    optimizer moves below this projection, then scores them once and not once
    per rule.
    """

    def facts(candidates: Column) -> Column:
        best = F.try_element_at(candidates, F.lit(1))
        second = F.try_element_at(candidates, F.lit(2))
        return F.struct(
            F.when(is_complete(), best["ledger_record"]).alias("found"),
            best["semantic_score"].alias("score"),
            second["semantic_score"].alias("second"),
        )

    def compared(f: Column) -> Column:
        found = f["found"]
        same_id = (F.col("invoice_id") != "") & (F.col("invoice_id") == found["invoice_id"])
        same_vendor_and_date = (
            F.lower(strip(F.col("vendor"))) == F.lower(strip(found["vendor"]))
        ) & (F.col("invoice_date") == found["invoice_date"])
        return F.struct(
            found.alias("found"),
            f["score"].alias("score"),
            f["second"].alias("second"),
            (
                F.coalesce(same_id, F.lit(False))
                | F.coalesce(same_vendor_and_date, F.lit(False))
            ).alias("same"),
            (f["score"] - f["second"]).alias("gap"),
            relative_difference(found["fx_rate"], F.col("fx_rate")).alias("fx"),
            F.round(F.col("amount") - found["amount"], 2).alias("delta"),
        )

    def decided(c: Column) -> Column:
        return _decision(c, threshold, margin, identity_overrides_threshold)

    result = let(let(let(F.col("candidates"), facts), compared), decided)
    return df.withColumn("_result", result).select(
        *df.columns,
        F.col("_result.best_match").alias("best_match"),
        F.col("_result.status").alias("status"),
        F.col("_result.confidence").alias("confidence"),
        F.col("_result.details").alias("details"),
    )


def _decision(
    c: Column, threshold: float, margin: float, identity_overrides_threshold: bool
) -> Column:
    found, score, same = c["found"], c["score"], c["same"]
    doubt = F.greatest(F.lit(0.0), F.round(1 - F.greatest(score, F.lit(0.0)), 4))
    below = score < threshold
    if identity_overrides_threshold:
        below = below & ~same
    incomplete = details(reason=F.lit("fields are missing"))
    no_candidate = details(reason=F.lit("no ledger candidate was found"))
    too_low = details(
        reason=F.lit("best similarity is below the threshold"), best_semantic_score=score
    )
    too_close = details(
        reason=F.lit("identity not verified and the two best candidates are too close"),
        best_score=score,
        second_score=c["second"],
        score_gap=F.round(c["gap"], 4),
    )
    not_the_same = details(
        reason=F.lit("best candidate shares neither id nor vendor and date"),
        input_invoice_id=F.col("invoice_id"),
        candidate_invoice_id=found["invoice_id"],
        input_vendor=F.col("vendor"),
        candidate_vendor=found["vendor"],
    )
    currency = details(
        invoice_currency=F.col("currency"), ledger_currency=found["currency"]
    )
    quantity = details(
        invoice_quantity=F.col("quantity"),
        ledger_quantity=found["quantity"],
        quantity_delta=F.col("quantity") - found["quantity"],
    )
    fx_rate = details(
        invoice_fx_rate=F.col("fx_rate"),
        ledger_fx_rate=found["fx_rate"],
        relative_fx_rate_difference=F.round(c["fx"], 4),
    )
    amount = details(
        invoice_amount=F.col("amount"), ledger_amount=found["amount"], amount_delta=c["delta"]
    )
    agreed = details(reason=F.lit("identity, currency, quantity, rate and amount agree"))
    sure = F.round(score, 4)
    rules = [
        (~is_complete(), "unmatched", F.lit(1.0), incomplete),
        (found.isNull(), "unmatched", F.lit(1.0), no_candidate),
        (below, "unmatched", doubt, too_low),
        (~same & (c["gap"] < margin), "ambiguous", sure, too_close),
        (~same, "unmatched", doubt, not_the_same),
        (F.col("currency") != found["currency"], "currency_mismatch", sure, currency),
        (F.col("quantity") != found["quantity"], "quantity_mismatch", sure, quantity),
        (c["fx"] > S.FX_TOLERANCE, "fx_mismatch", sure, fx_rate),
        (F.abs(c["delta"]) > S.AMOUNT_TOLERANCE, "amount_mismatch", sure, amount),
    ]

    def outcome(status: str, confidence: Column, told: Column) -> Column:
        return F.struct(
            found.alias("best_match"),
            F.lit(status).alias("status"),
            confidence.alias("confidence"),
            told.alias("details"),
        )

    chain = F
    for applies, *result in rules:
        chain = chain.when(applies, outcome(*result))
    return chain.otherwise(outcome("matched", sure, agreed))

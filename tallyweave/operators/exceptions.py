"""Explaining exceptions: root cause, severity, summary and dispute draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.functions.money import money_text

# Root cause and severity of each status.
ROOT_CAUSES = {
    "amount_mismatch": ("amount_mismatch", "high"),
    "quantity_mismatch": ("quantity_mismatch", "high"),
    "fx_mismatch": ("fx_mismatch", "medium"),
    "currency_mismatch": ("currency_mismatch", "high"),
    "duplicate_charge": ("duplicate_charge", "high"),
    "ambiguous": ("ambiguous_match", "medium"),
    "unmatched": ("unmatched_invoice", "medium"),
}
NO_ACTION = ("no_action_required", "none")

ACTIONS = {
    "amount_mismatch": "Stop the payment until a corrected invoice or an approval arrives.",
    "quantity_mismatch": "Ask for proof of the delivered quantity before paying.",
    "fx_mismatch": "Check the agreed source of the exchange rate.",
    "currency_mismatch": "Stop the payment and confirm the currency of the contract.",
    "duplicate_charge": "Block the payment and find out why the invoice came again.",
    "ambiguous": "Let an analyst choose the ledger record.",
    "unmatched": "Check id, vendor and date before writing to the vendor.",
}


def _by_status(status: Column, values: dict[str, Column], otherwise: Column) -> Column:
    chain = F
    for name, value in values.items():
        chain = chain.when(status == name, value)
    return chain.otherwise(otherwise)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def investigate(df: DataFrame) -> DataFrame:
    """Add root cause, severity, summary, recommended action and dispute reason.

    Everything said comes from the record's fields and ``details``.
    """
    d = F.col("details")
    status = F.coalesce(F.col("status"), F.lit("unmatched"))
    currency = F.coalesce(F.col("currency"), F.lit(S.DEFAULT_CURRENCY))
    who = F.concat(
        F.lit("Invoice "),
        F.coalesce(F.col("invoice_id"), F.lit(S.NO_INVOICE_ID)),
        F.lit(" of "),
        F.coalesce(F.col("vendor"), F.lit(S.NO_VENDOR)),
    )
    summaries = {
        "amount_mismatch": F.concat(
            who,
            F.lit(" bills "),
            money_text(d["invoice_amount"], currency),
            F.lit("; the ledger has "),
            money_text(d["ledger_amount"], currency),
            F.lit("."),
        ),
        "quantity_mismatch": F.concat(
            who,
            F.lit(" counts "),
            _text(d["invoice_quantity"]),
            F.lit("; the ledger has "),
            _text(d["ledger_quantity"]),
            F.lit("."),
        ),
        "fx_mismatch": F.concat(
            who,
            F.lit(" applies rate "),
            _text(d["invoice_fx_rate"]),
            F.lit("; the ledger has "),
            _text(d["ledger_fx_rate"]),
            F.lit("."),
        ),
        "currency_mismatch": F.concat(
            who,
            F.lit(" is in "),
            _text(d["invoice_currency"]),
            F.lit("; the ledger has "),
            _text(d["ledger_currency"]),
            F.lit("."),
        ),
        "duplicate_charge": F.concat(who, F.lit(" was already reconciled.")),
        "ambiguous": F.concat(who, F.lit(" resembles several ledger records.")),
        "unmatched": F.concat(who, F.lit(" has no valid ledger record.")),
    }
    reasons = {
        "amount_mismatch": F.concat(
            F.lit("The amount is off by "), money_text(d["amount_delta"], currency), F.lit(".")
        ),
        "quantity_mismatch": F.concat(
            F.lit("The quantity is off by "), _text(d["quantity_delta"]), F.lit(".")
        ),
        "fx_mismatch": F.concat(
            F.lit("The exchange rate is off by "),
            F.format_string(
                "%.2f",
                F.round(F.coalesce(d["relative_fx_rate_difference"], F.lit(0.0)) * 100, 2),
            ),
            F.lit("%."),
        ),
        "currency_mismatch": F.lit("The currencies differ."),
        "duplicate_charge": F.lit("The invoice may be charged twice."),
        "ambiguous": F.lit("More than one ledger record may be meant."),
        "unmatched": F.lit("There is no ledger record."),
    }
    causes = {s: F.lit(cause) for s, (cause, _) in ROOT_CAUSES.items()}
    severities = {s: F.lit(severity) for s, (_, severity) in ROOT_CAUSES.items()}
    actions = {s: F.lit(action) for s, action in ACTIONS.items()}
    summary = _by_status(status, summaries, F.concat(who, F.lit(" agrees with the ledger.")))
    return df.withColumns(
        {
            "root_cause": _by_status(status, causes, F.lit(NO_ACTION[0])),
            "severity": _by_status(status, severities, F.lit(NO_ACTION[1])),
            "summary": summary,
            "recommended_action": _by_status(status, actions, F.lit("Nothing to do.")),
            "dispute_reason": _by_status(status, reasons, F.lit("")),
            "hypotheses": F.array(summary),
        }
    )


def draft_letters(df: DataFrame, sender: str = "Accounts Payable") -> DataFrame:
    """Add ``dispute_draft``: a letter to the vendor, empty when nothing is open."""
    letter = F.concat(
        F.lit("Subject: Question about invoice "),
        F.coalesce(F.col("invoice_id"), F.lit("named below")),
        F.lit("\n\nTo "),
        F.coalesce(F.col("vendor"), F.lit("the vendor")),
        F.lit(",\n\nwe could not settle your invoice dated "),
        F.coalesce(F.col("invoice_date").cast("string"), F.lit("as shown")),
        F.lit(" over "),
        money_text(
            F.coalesce(F.col("amount"), F.lit(0.0)),
            F.coalesce(F.col("currency"), F.lit(S.DEFAULT_CURRENCY)),
        ),
        F.lit(".\n\n"),
        F.col("summary"),
        F.lit("\n"),
        F.col("dispute_reason"),
        F.lit("\n\nOur next step: "),
        F.col("recommended_action"),
        F.lit("\nPlease send documents or a corrected invoice.\n\n"),
        F.lit(sender),
        F.lit("\n"),
    )
    clean = F.coalesce(F.col("status"), F.lit("unmatched")).isin("matched", "no_action_required")
    return df.withColumn("dispute_draft", F.when(clean, F.lit("")).otherwise(letter))


def exception_queue(df: DataFrame) -> DataFrame:
    """The invoices that need attention, with status, confidence and details."""
    return df.filter(F.coalesce(F.col("status"), F.lit("unmatched")) != "matched").select(
        "submission_id",
        F.struct(*[F.col(n) for n in S.RECORD_FIELDS]).alias("invoice"),
        "status",
        "confidence",
        "details",
    )

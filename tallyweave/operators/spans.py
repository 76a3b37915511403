"""Labelled spans of a document as an invoice record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.functions.dates import parse_date
from tallyweave.functions.money import last_amount
from tallyweave.functions.text import strip
from tallyweave.operators.extraction import norm_currency
from tallyweave.operators.labeling import best_span


def overall_confidence(best: list[Column]) -> Column:
    """Mean score of the spans that were found, 0 if none was."""
    found = F.array_compact(F.array(*[span["score"] for span in best]))
    mean = F.aggregate(found, F.lit(0.0), lambda total, s: total + s) / F.size(found)
    return F.when(F.size(found) > 0, F.round(mean, 4)).otherwise(F.lit(0.0))


def span_records(docs: DataFrame, keep: list[str], spans: str = "spans", text: str = "text") -> DataFrame:
    """``keep``, a record in normalised form, and the confidence of its fields.

    The best span of each type speaks for its field.  A field without a
    readable span gets its placeholder; the currency is looked for in the
    total's span, and in the whole text only if there is no such span.  A NULL
    text, or NULL spans, count as empty.
    """
    best = docs.select(
        *keep,
        F.coalesce(F.col(text), F.lit("")).alias("_raw"),
        *[best_span(F.col(spans), kind).alias(f"_{kind}") for kind in S.ENTITY_TYPES],
    )
    vendor, date, total = (F.col(f"_{kind}") for kind in ("VENDOR", "DATE", "TOTAL"))
    score = lambda span: F.coalesce(span["score"], F.lit(0.0))
    return best.select(
        *keep,
        F.lit(S.NO_INVOICE_ID).alias("invoice_id"),
        F.coalesce(parse_date(date["text"]), F.to_date(F.lit(S.NO_DATE))).alias("invoice_date"),
        F.coalesce(strip(vendor["text"]), F.lit(S.NO_VENDOR)).alias("vendor"),
        F.coalesce(last_amount(total["text"]), F.lit(S.NO_AMOUNT)).alias("amount"),
        norm_currency(F.coalesce(total["text"], F.col("_raw"))).alias("currency"),
        F.lit(S.DEFAULT_QUANTITY).alias("quantity"),
        F.lit(1.0).alias("fx_rate"),
        overall_confidence([vendor, date, total]).alias("overall_confidence"),
        score(vendor).alias("vendor_confidence"),
        score(date).alias("invoice_date_confidence"),
        score(total).alias("amount_confidence"),
    )

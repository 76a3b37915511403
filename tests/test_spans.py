"""Spans as invoice records."""

import datetime as dt

from tallyweave import schemas as S
from tallyweave.operators.spans import span_records

SPAN = "array<struct<entity_type string, text string, score double, start_word int, end_word int>>"


def records(spark, *rows):
    docs = spark.createDataFrame(
        [(n, text, spans) for n, (text, spans) in enumerate(rows)], f"n int, text string, spans {SPAN}"
    )
    return [r for r in span_records(docs, ["n"]).orderBy("n").collect()]


def test_spans_become_a_record(spark):
    (row,) = records(
        spark,
        (
            "paid in EUR",
            [
                ("VENDOR", " Low ", 0.5, 0, 0),
                ("VENDOR", " Acme Ltd ", 0.75, 1, 2),
                ("VENDOR", "Late", 0.75, 9, 9),
                ("DATE", "3 March 2026", 0.5, 3, 5),
                ("TOTAL", "RM 9.00 of 1.234,56", 1.0, 6, 9),
            ],
        ),
    )
    assert (row.vendor, row.invoice_date, row.amount) == ("Acme Ltd", dt.date(2026, 3, 3), 1234.56)
    assert row.currency == "MYR"  # the total's own text speaks, not the document's
    assert (row.invoice_id, row.quantity, row.fx_rate) == (S.NO_INVOICE_ID, 1, 1.0)
    assert (row.vendor_confidence, row.invoice_date_confidence, row.amount_confidence) == (0.75, 0.5, 1.0)
    assert row.overall_confidence == 0.75


def test_missing_spans_give_placeholders(spark):
    nothing, null, unread = records(
        spark,
        ("due 5 USD", []),
        (None, None),
        ("EUR", [("DATE", "soon", 0.25, 0, 0), ("TOTAL", "much", 0.5, 1, 1)]),
    )
    for row, currency in ((nothing, "USD"), (null, "MYR")):
        assert (row.vendor, row.amount, row.currency) == (S.NO_VENDOR, 0.0, currency)
        assert (row.invoice_date, row.overall_confidence) == (dt.date(1970, 1, 1), 0.0)
    assert (unread.amount, unread.invoice_date, unread.currency) == (0.0, dt.date(1970, 1, 1), "MYR")
    assert unread.overall_confidence == 0.375

"""Small records for tests."""

from datetime import date

from pyspark.sql import functions as F

RECORD = (
    "invoice_id string, invoice_date date, vendor string, amount double, currency string, "
    "quantity int, fx_rate double"
)


def record(**changes):
    base = {
        "invoice_id": "INV-00001",
        "invoice_date": date(2026, 1, 15),
        "vendor": "Acme Corp",
        "amount": 1000.0,
        "currency": "EUR",
        "quantity": 10,
        "fx_rate": 1.0,
    }
    return tuple({**base, **changes}.values())


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def submissions(spark, *rows):
    numbered = [(i, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, f"submission_id bigint, {RECORD}")


def evaluate(spark, value, *expressions):
    """Results of column expressions over one text value."""
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(*[e(F.col("v")) for e in expressions]).first()

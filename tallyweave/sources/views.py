"""Invoice tables derived from the order tables, for runs without a ledger.

Money and rate variants are worked out in whole cents and ten-thousandths, so
that every engine agrees on them to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.session import spread

# Scenario of an order, by its key modulo seven.
SCENARIOS = [
    "matched",
    "amount_mismatch",
    "fx_mismatch",
    "quantity_mismatch",
    "duplicate_charge",
    "currency_mismatch",
    "unmatched",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, in at least one task per core."""
    return spread(table(spark, folder, name).select(*columns))


def pick(c: Column, values: list[str]) -> Column:
    """The value at position ``c``."""
    chosen = F
    for place, value in enumerate(values[:-1]):
        chosen = chosen.when(c == place, F.lit(value))
    return chosen.otherwise(F.lit(values[-1]))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One ledger row per order: the customer is the vendor."""
    orders = spread_table(
        spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    quantities = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").cast("int").alias("q"))
    )
    key = F.col("o_orderkey")
    return (
        orders.join(customers, F.col("c_custkey") == F.col("o_custkey"))
        .join(quantities, F.col("l_orderkey") == key, "left")
        .select(
            key.alias("k"),
            F.concat(F.lit("INV-"), F.lpad(key.cast("string"), 8, "0")).alias("invoice_id"),
            F.col("o_orderdate").cast("date").alias("invoice_date"),
            F.col("c_name").alias("vendor"),
            F.round("o_totalprice", 2).alias("amount"),
            pick(key % 4, ["EUR", "USD", "GBP", "PLN"]).alias("currency"),
            F.coalesce("q", F.lit(1)).alias("quantity"),
            F.when(key % 4 == 0, F.lit(1.0))
            .otherwise(F.round((85 + key % 36).cast("double") / 100, 4))
            .alias("fx_rate"),
        )
    )


def _whole(numerator: Column, divisor: Column) -> Column:
    return ((numerator - numerator % divisor) / divisor).cast("long")


def document_variants(ledger_rows: DataFrame) -> DataFrame:
    """The document side of every ledger row, changed as its scenario says.

    ``cents`` and ``rate`` hold the document's amount and exchange rate as
    whole numbers.
    """
    cents = F.round(F.col("amount") * 100).cast("long")
    rate = F.round(F.col("fx_rate") * 10000).cast("long")
    scenario = F.col("scenario")
    staged = ledger_rows.withColumns(
        {
            "scenario": pick(F.col("k") % 7, SCENARIOS),
            "_cents": cents,
            "_rate": rate,
        }
    ).withColumns(
        {
            "_rate2": F.when(
                scenario == "fx_mismatch", _whole(F.col("_rate") * 108, F.lit(100))
            ).otherwise(F.col("_rate")),
            "_quantity2": F.when(
                scenario == "quantity_mismatch", F.col("quantity") + 2
            ).otherwise(F.col("quantity")),
        }
    )
    changed = (
        F.when(scenario == "amount_mismatch", F.col("_cents") + 3750)
        .when(scenario == "fx_mismatch", _whole(F.col("_cents") * F.col("_rate2"), F.col("_rate")))
        .when(
            scenario == "quantity_mismatch",
            _whole(F.col("_cents") * F.col("_quantity2"), F.col("quantity").cast("long")),
        )
        .otherwise(F.col("_cents"))
    )
    unknown = scenario == "unmatched"
    return staged.select(
        (F.col("k") * 2).alias("submission_id"),
        "scenario",
        F.when(unknown, F.concat(F.lit("X"), "invoice_id"))
        .otherwise(F.col("invoice_id"))
        .alias("invoice_id"),
        "invoice_date",
        F.when(unknown, F.concat(F.lit("Unlisted "), "vendor"))
        .otherwise(F.col("vendor"))
        .alias("vendor"),
        (changed.cast("double") / 100).alias("amount"),
        F.when(scenario != "currency_mismatch", F.col("currency"))
        .when(F.col("currency") == "EUR", F.lit("USD"))
        .otherwise(F.lit("EUR"))
        .alias("currency"),
        F.col("_quantity2").alias("quantity"),
        (F.col("_rate2").cast("double") / 10000).alias("fx_rate"),
    )


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Submitted invoices; a duplicate charge is submitted twice."""
    variants = document_variants(ledger(spark, folder))
    copies = F.when(
        F.col("scenario") == "duplicate_charge", F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    return (
        variants.withColumn("_copy", F.explode(copies))
        .withColumn("submission_id", F.col("submission_id") + F.col("_copy"))
        .drop("_copy")
    )


def invoice_text(submitted: DataFrame) -> DataFrame:
    """One text document per submission, with its lines."""
    amount = F.col("amount").cast("decimal(18,2)").cast("string")
    rate = F.col("fx_rate").cast("decimal(10,4)").cast("string")
    quantity = F.col("quantity").cast("string")
    lines = F.array(
        F.col("vendor"),
        F.lit("INVOICE"),
        F.concat(F.lit("Invoice No.: "), "invoice_id"),
        F.concat(F.lit("Invoice Date: "), F.col("invoice_date").cast("string")),
        F.concat(F.lit("Currency: "), "currency"),
        F.concat(F.lit("FX Rate: "), rate),
        F.lit("Description Qty Unit Price Line Total"),
        F.concat(F.lit("Services "), quantity, F.lit(" "), amount),
        F.concat(F.lit("Subtotal "), amount),
        F.lit("Tax 0.00"),
        F.concat(F.lit("TOTAL DUE "), amount, F.lit(" "), F.col("currency")),
    )
    return submitted.select(
        "submission_id",
        "scenario",
        lines.alias("lines"),
        F.array_join(lines, "\n").alias("text"),
    )


def corrupted(submitted: DataFrame) -> DataFrame:
    """Typical misreads: a digit put before the amount, a quantity lost."""
    key = _whole(F.col("submission_id"), F.lit(2))
    prefixed = F.concat(
        F.lit("1"), F.col("amount").cast("decimal(18,2)").cast("string")
    ).cast("double")
    return submitted.withColumns(
        {
            "amount": F.when(key % 11 == 0, prefixed).otherwise(F.col("amount")),
            "quantity": F.when(key % 13 == 0, F.lit(S.DEFAULT_QUANTITY)).otherwise(
                F.col("quantity")
            ),
        }
    )

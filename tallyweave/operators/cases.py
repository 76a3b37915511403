"""Making test cases from a ledger: injected errors, balanced sets, synthetic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.sources.views import pick


def _cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def _scaled(value: Column, by: Column, over: Column) -> Column:
    """``value * by / over`` in whole units, rounded down."""
    product = value * by
    return ((product - product % over) / over).cast("long")


def _sample(ledger: DataFrame, seed: str, size: int) -> DataFrame:
    """``size`` ledger rows chosen by a seeded hash of their key."""
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string")))
    return ledger.orderBy(rank, "k").limit(size)


def inject_discrepancies(
    ledger: DataFrame, duplicates: int = 20, fx_errors: int = 15, quantity_errors: int = 15
) -> DataFrame:
    """The ledger with three small sets of faulty copies appended.

    Copies differ by up to a tenth in amount or rate, or by -1, 1 or 2 in
    quantity; the amount follows rate and quantity.
    """
    permille = 900 + F.col("k") * 7919 % 201
    cents = _cents(F.col("amount"))
    rate = F.round(F.col("fx_rate") * 10000).cast("long")
    copies = _sample(ledger, "duplicate", duplicates).withColumns(
        {"amount": _scaled(cents, permille, F.lit(1000)) / 100, "origin": F.lit("duplicate")}
    )
    new_rate = _scaled(rate, permille, F.lit(1000))
    rates = _sample(ledger, "fx", fx_errors).withColumns(
        {
            "amount": _scaled(cents, new_rate, rate) / 100,
            "fx_rate": new_rate / 10000,
            "origin": F.lit("fx_error"),
        }
    )
    step = F.when(F.col("k") % 3 == 0, -1).when(F.col("k") % 3 == 1, 1).otherwise(2)
    quantity = F.col("quantity") + step
    quantities = _sample(ledger, "quantity", quantity_errors).withColumns(
        {
            "amount": _scaled(cents, quantity.cast("long"), F.col("quantity").cast("long")) / 100,
            "quantity": quantity,
            "origin": F.lit("quantity_error"),
        }
    )
    return (
        ledger.withColumn("origin", F.lit("ledger"))
        .unionByName(copies)
        .unionByName(rates)
        .unionByName(quantities)
    )


def balanced_cases(cases: DataFrame, per_scenario: int = 30) -> DataFrame:
    """The same number of cases of each scenario, with running case ids."""
    nth = Window.partitionBy("scenario").orderBy("submission_id")
    return (
        cases.withColumn("nth", F.row_number().over(nth))
        .filter(F.col("nth") <= per_scenario)
        .withColumn(
            "case_id", F.concat(F.col("scenario"), F.lit("-"), F.lpad(F.col("nth").cast("string"), 3, "0"))
        )
        .drop("nth")
    )


def synthetic_ledger(
    spark: SparkSession, rows: int, vendors: list[str], seed: int = S.SPLIT_SEED
) -> DataFrame:
    """``rows`` ledger records whose values follow from their number and the seed."""

    def draw(name: str, low: int, high: int) -> Column:
        span = high - low + 1
        return (low + F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), "id"), F.lit(span))).cast("long")

    drawn = spark.range(1, rows + 1).select(
        "id",
        F.concat(F.lit("INV-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("invoice_id"),
        F.date_add(F.lit("2025-01-01").cast("date"), draw("date", 0, 599).cast("int")).alias(
            "invoice_date"
        ),
        pick(draw("vendor", 0, len(vendors) - 1), vendors).alias("vendor"),
        pick(draw("currency", 0, 3), ["EUR", "USD", "GBP", "PLN"]).alias("currency"),
        draw("quantity", 1, 50).cast("int").alias("quantity"),
        draw("price", 1000, 50000).alias("unit_cents"),
        draw("rate", 8500, 12000).alias("rate"),
    )
    rate = F.when(F.col("currency") == "EUR", F.lit(10000)).otherwise(F.col("rate"))
    cents = F.col("quantity") * F.col("unit_cents") * rate
    return drawn.select(
        F.col("id").alias("k"),
        "invoice_id",
        "invoice_date",
        "vendor",
        F.round(cents / 1_000_000, 2).alias("amount"),
        "currency",
        "quantity",
        (rate / 10000).alias("fx_rate"),
        F.to_json(
            F.array(
                F.struct(
                    F.lit("Professional services").alias("desc"),
                    F.col("quantity").alias("qty"),
                    (F.col("unit_cents") / 100).alias("price"),
                )
            )
        ).alias("line_items"),
    )


ITEM_KEYS = "array<struct<desc:string,description:string,qty:int,quantity:int,price:double,unit_price:double>>"


def unify_items(invoices: DataFrame, items: str = "line_items") -> DataFrame:
    """Turn ``line_items`` JSON into ``items`` with one set of names.

    Both spellings of each key are read.  Without usable items the invoice
    itself becomes a single item, its unit price worked back from the amount.
    """
    parsed = F.from_json(F.col(items), ITEM_KEYS)
    default = F.lit("Professional services")

    def unified(item: Column) -> Column:
        quantity = F.coalesce(item["qty"], item["quantity"], F.col("quantity"))
        return F.struct(
            F.coalesce(item["desc"], item["description"], default).alias("description"),
            quantity.alias("qty"),
            F.coalesce(
                item["price"],
                item["unit_price"],
                F.col("amount") / F.greatest(quantity, F.lit(1)),
            ).alias("price"),
        )

    worked_back = F.round(
        F.col("amount") / F.greatest(F.col("quantity") * F.col("fx_rate"), F.lit(1.0)), 2
    )
    single = F.array(
        F.struct(
            default.alias("description"),
            F.col("quantity").alias("qty"),
            worked_back.alias("price"),
        )
    )
    return invoices.withColumn("_parsed", parsed).withColumn(
        "items",
        F.when(F.size("_parsed") > 0, F.transform("_parsed", unified)).otherwise(single),
    ).drop("_parsed")


def items_total(items: Column, fx_rate: Column) -> Column:
    """Sum of the rounded item totals in the invoice's currency."""
    totals = F.transform(items, lambda i: F.round(i["qty"] * i["price"] * fx_rate, 2))
    return F.round(F.aggregate(totals, F.lit(0.0), lambda total, t: total + t), 2)

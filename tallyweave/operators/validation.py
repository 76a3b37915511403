"""Field checks, completeness and outcome splits, field-by-field comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.functions.money import to_double
from tallyweave.functions.text import letter_count, norm_text, strip


def _decided(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_invoice_id(c: Column) -> Column:
    shape = F.upper(c).rlike(r"^[A-Z0-9][A-Z0-9_-]{3,}$")
    return _decided((c != S.NO_INVOICE_ID) & shape)


def valid_vendor(c: Column) -> Column:
    return _decided((c != S.NO_VENDOR) & (letter_count(c) >= 3))


def valid_date(c: Column) -> Column:
    """Shape only: the sentinel date passes."""
    return _decided(c.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"))


def valid_amount(c: Column) -> Column:
    value = c.try_cast("double")
    return _decided((value > 0) & (value < 10_000_000))


def valid_currency(c: Column) -> Column:
    return _decided(c.isin(*S.CURRENCIES))


def valid_quantity(c: Column) -> Column:
    return _decided(c.try_cast("int").between(1, 10_000))


def valid_fx_rate(c: Column) -> Column:
    return _decided(c.try_cast("double").between(0.01, 1000))


CHECKS = {
    "invoice_id": valid_invoice_id,
    "vendor": valid_vendor,
    "invoice_date": valid_date,
    "amount": valid_amount,
    "currency": valid_currency,
    "quantity": valid_quantity,
    "fx_rate": valid_fx_rate,
}


def validation_flags(prefix: str = "valid_") -> dict[str, Column]:
    """One boolean column per record field."""
    return {prefix + name: check(F.col(name)) for name, check in CHECKS.items()}


def coerce_records(raw: DataFrame) -> DataFrame:
    """Typed record fields from text columns, with ``rejected`` for bad rows.

    A row is rejected when a required field is absent or cannot be read.
    """
    text = {name: strip(F.col(name)) for name in ("amount", "quantity", "fx_rate")}
    typed = raw.withColumns(
        {
            "invoice_date": F.date_format(F.to_date(F.try_to_timestamp("invoice_date")), "yyyy-MM-dd"),
            "amount": to_double(text["amount"]),
            "quantity": F.when(
                text["quantity"].rlike(r"^[+-]?\d+$"), text["quantity"].try_cast("int")
            ),
            "fx_rate": to_double(text["fx_rate"]),
        }
    )
    missing = F.lit(False)
    for name in S.RECORD_FIELDS:
        missing = missing | F.col(name).isNull()
    return typed.withColumn("rejected", missing)


def is_complete() -> Column:
    """All seven fields present."""
    present = F.lit(True)
    for name in S.RECORD_FIELDS:
        present = present & F.col(name).isNotNull()
    return present


def completeness_route() -> Column:
    return F.when(is_complete(), F.lit("reconcile")).otherwise(F.lit("exception"))


def outcome_route(status: Column) -> Column:
    clean = F.coalesce(status, F.lit("unmatched")) == "matched"
    return F.when(clean, F.lit("audit")).otherwise(F.lit("exception"))


def split_by(df: DataFrame, route: Column, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows that take ``value`` and the rest."""
    routed = df.withColumn("route", route)
    return routed.filter(F.col("route") == value), routed.filter(F.col("route") != value)


def same_identity(left: str, right: str) -> Column:
    """Equal non-empty id, or equal vendor (case and margin ignored) and date.

    ``left`` and ``right`` are column prefixes such as ``"led_"``.
    """

    def field(prefix: str, name: str) -> Column:
        return F.col(f"{prefix}{name}")

    same_id = (field(left, "invoice_id") != "") & (
        field(left, "invoice_id") == field(right, "invoice_id")
    )
    same_vendor = F.lower(strip(field(left, "vendor"))) == F.lower(strip(field(right, "vendor")))
    same_date = field(left, "invoice_date") == field(right, "invoice_date")
    return _decided(same_id) | _decided(same_vendor & same_date)


def relative_difference(expected: Column, actual: Column) -> Column:
    return F.when(
        expected == 0, F.when(actual == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    ).otherwise(F.abs(expected - actual) / F.abs(expected))


def _cents_apart(left: Column, right: Column) -> Column:
    return F.abs(left - right)


def field_matches(
    predicted: str, truth: str, with_fx: bool = True, prefix: str = "ok_"
) -> dict[str, Column]:
    """Per-field equality of two records held side by side under two prefixes."""

    def pair(name: str) -> tuple[Column, Column]:
        return F.col(predicted + name), F.col(truth + name)

    flags: dict[str, Column] = {}
    for name in S.RECORD_FIELDS:
        left, right = pair(name)
        if name in ("invoice_id", "vendor"):
            equal = norm_text(left) == norm_text(right)
        elif name == "amount":
            equal = _cents_apart(left, right) <= S.AMOUNT_TOLERANCE
        elif name == "fx_rate":
            equal = F.abs(left - right) <= S.EVAL_FX_TOLERANCE
        else:
            equal = left == right
        if name != "fx_rate" or with_fx:
            flags[prefix + name] = _decided(equal)
    return flags


def with_fallback(
    primary: DataFrame, secondary: DataFrame, key: str, secondary_prefix: str = "alt_"
) -> DataFrame:
    """Fill invalid vendor, date and amount from a second extraction.

    ``secondary`` holds one row per ``key``.  Only these three fields may be
    replaced, and only by a value that is itself valid; ``fallbacks`` lists
    every replacement.
    """
    fields = ["vendor", "invoice_date", "amount"]
    renamed = secondary.select(
        key, *[F.col(name).alias(secondary_prefix + name) for name in fields]
    )
    joined = primary.join(renamed, key, "left")
    uses = {
        name: ~CHECKS[name](F.col(name)) & CHECKS[name](F.col(secondary_prefix + name))
        for name in fields
    }
    log = F.array(
        *[
            F.when(
                uses[name],
                F.struct(
                    F.lit(name).alias("field"),
                    F.col(name).cast("string").alias("original_value"),
                    F.col(secondary_prefix + name).cast("string").alias("fallback_value"),
                ),
            )
            for name in fields
        ]
    )
    chosen = {
        name: F.when(uses[name], F.col(secondary_prefix + name)).otherwise(F.col(name))
        for name in fields
    }
    return joined.withColumns({**chosen, "fallbacks": F.array_compact(log)}).drop(
        *[secondary_prefix + name for name in fields]
    )

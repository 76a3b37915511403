"""Amounts written as text, and text written from amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.arrays import let

# What counts as a money-like number.
MONEY_PATTERN = (
    r"(?i)(?<!\d)(?:€|\$|£|RM|MYR)?\s*"
    r"(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})|\d+[.,]\d{2})"
    r"\s*(?:EUR|USD|GBP|PLN|MYR|RM|€|\$|£|ZŁ)?"
)
#: Found in a text exactly if ``MONEY_PATTERN`` is, as that may begin where the digits do, and found sooner.
HAS_MONEY_PATTERN = r"\d[.,]\d{2}"
SIGNED_MONEY_PATTERN = r"(-?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})|-?\d+[.,]\d{2})"
NUMERIC_TEXT_CODES = r"RM|EUR|USD|GBP|MYR|SGD"

_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_double(c: Column) -> Column:
    """Number or NULL; refuses the suffixes and words Java would read as a double."""
    return let(c, lambda v: F.when(v.rlike(_PLAIN_NUMBER), v.try_cast("double")))


def dotted(c: Column) -> Column:
    """Digits with a dot as decimal mark, whatever separators were used.

    With both marks present the later one is the decimal mark and the other
    one groups thousands; a comma alone is a decimal mark.
    """

    def by_marks(v: Column) -> Column:
        comma_from_end = F.instr(F.reverse(v), ",")
        dot_from_end = F.instr(F.reverse(v), ".")
        both = (comma_from_end > 0) & (dot_from_end > 0)
        return (
            F.when(
                both & (comma_from_end < dot_from_end),
                F.translate(F.translate(v, ".", ""), ",", "."),
            )
            .when(both, F.translate(v, ",", ""))
            .otherwise(F.translate(v, ",", "."))
        )

    return let(c, by_marks)


def parse_amount(c: Column) -> Column:
    """Amount of a European or US style number, NULL if it is none."""
    return F.round(to_double(dotted(F.regexp_replace(c, r"^\s+|\s+$| ", ""))), 2)


def money_values(c: Column) -> Column:
    """Every money-like number of a line, as text."""
    return F.regexp_extract_all(c, F.lit(MONEY_PATTERN), F.lit(1))


def last_amount(c: Column) -> Column:
    """Last, possibly negative, money-like number of a text span."""
    found = F.regexp_extract_all(c, F.lit(SIGNED_MONEY_PATTERN), F.lit(1))
    return parse_amount(F.try_element_at(found, F.lit(-1)))


def norm_numeric(c: Column) -> Column:
    """Two-decimal text of a money-like string, ``''`` if it is none."""
    kept = F.regexp_replace(
        F.regexp_replace(F.upper(c), NUMERIC_TEXT_CODES, ""), r"[^0-9,.\-]", ""
    )
    return F.coalesce(two_decimals_or_null(to_double(dotted(kept))), F.lit(""))


def two_decimals_or_null(c: Column) -> Column:
    """``two_decimals``, but NULL for NULL (``format_string`` writes the word)."""
    return let(c, lambda v: F.when(v.isNotNull(), two_decimals(v)))


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c)


def money_text(value: Column, currency: Column, missing: str = "unknown amount") -> Column:
    """``1,234.50 EUR``, or ``missing`` when there is no value."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(
        F.concat(F.format_number(value, 2), F.lit(" "), currency)
    )

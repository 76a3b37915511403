"""Text normalisers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` knows blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Strip, and turn every inner run of white space into one blank."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column) -> Column:
    """Comparison form of ids and names: lower case, no commas or dots."""
    return squeeze(F.translate(F.lower(c.cast("string")), ",.", ""))


def norm_alnum(c: Column) -> Column:
    """Comparison form of receipt words: runs of ``[a-z0-9]`` joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def norm_line(c: Column) -> Column:
    """Upper-cased line with squeezed white space."""
    return squeeze(F.upper(c))


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def contains_any(c: Column, terms: list[str]) -> Column:
    """True if ``c`` contains one of the literal ``terms``."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(c, F.lit(term))
    return found


def first_of(values: Column) -> Column:
    """First array element, NULL if there is none."""
    return F.try_element_at(values, F.lit(1))

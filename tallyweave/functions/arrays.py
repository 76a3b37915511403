"""Working on a row's arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once.

    The optimizer may put a column's definition into a lambda that mentions
    it, to be evaluated anew for every element.  A lambda variable is a value,
    so inside ``body`` this cannot happen.
    """
    return F.transform(F.array(value), body)[0]


def indices(array: Column) -> Column:
    """``0 .. size - 1``, empty for an empty or absent array."""
    none = F.array().cast("array<int>")
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(none)

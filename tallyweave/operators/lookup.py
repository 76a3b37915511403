"""Looking keys up in a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``right``, unique per ``keys``, to ``left``, where one key may be very common.

    AQE splits a skewed partition only if both join inputs come straight from a
    shuffle.  A reduced ``right`` is partitioned by its keys already and would
    be joined without one, so a key hash joins the keys: it never changes the
    result, but ``right``, the smaller side, is shuffled once more, and the
    rows of a common key on the left are then shared out among tasks.  A small
    ``right`` is still broadcast, by its size.
    """
    name = "_guard"
    while name in left.columns or name in right.columns:
        name += "_"
    guard = F.xxhash64(*keys).alias(name)
    return left.select("*", guard).join(right.select("*", guard), [*keys, name], how).drop(name)

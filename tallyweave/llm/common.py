"""What the operators share: reading, stored stages, words and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import scratch, stored  # noqa: F401

#: Characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def split_words(text: Column) -> Column:
    """Words of a text between ASCII white space; none for NULL."""
    none = F.array().cast("array<string>")
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE)).otherwise(none)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column, parts: int) -> Column:
    """Whether a document is kept from learning: one of ``parts`` by its id.

    A document without an id is never learned from.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 1, F.lit(True))

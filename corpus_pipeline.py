"""From raw documents to token ids: five stages, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents.  A document
leaves if it is judged toxic, fails a quality rule, is a near copy of a kept
one, or holds a window of ten words of the benchmark; the last stage encodes
what is left.

Defined results: a NULL text is scored as an empty one, has no words and so fails the quality
rules; equal rows are copies, one of which stays; a NULL id stands last among
copies; texts of any length are judged whole; an empty table gives no rows, with the columns
of documents up to the last stage; other columns of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, decontamination, near_copies, quality, toxicity
from tallyweave.llm.common import held_out, read, stored
from tallyweave.llm.queries import TOXIC_FROM, TOXIC_PARTS, vocabulary_path
from tallyweave.session import tune


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the model learns from their labels."""
    tune(spark)
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit_from_tables(docs, labels, lambda i: ~held_out(i, TOXIC_PARTS))
    column = _unused(docs, "score")
    return toxicity.score(docs, model, column).where(F.col(column) < TOXIC_FROM).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    return quality.well_formed(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts linked by their SimHash fingerprints are candidates, each link confirmed by a five-word Jaccard
    of 0.8 or more; copies that the fingerprints leave apart are found by shared shingles.
    """
    tune(spark)
    return near_copies.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    column = _unused(docs, "found")
    found = decontamination.scan(docs, read(spark, sf_dir, "benchmark"), column)
    return found.where(F.col(column)["n_hit"] == 0).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    path = vocabulary_path()
    coded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "n_chars", "text"), path)
    return coded.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded"
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", bpe_stage),
]

#: Stages 1, 3 and 5 cannot be expressed in SQL; a brute-force version is tested instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

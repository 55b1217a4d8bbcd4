"""A corpus pipeline of five training-data stages; each takes and gives documents.

Every stage reads all rows and whole texts of what the one before it kept.  In
all of them a null text counts as empty, a text of any length is worked on
whole, an empty table gives an empty result, and further columns of any name are
kept untouched (the last stage gives its own columns only).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubeloom.llm import bpe, decontamination, exact_dedup, quality, simhash
from cubeloom.llm.common import remove_dir, shared_dir, table
from cubeloom.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.  Repeated rows share their fate; without labels all scores are 0.5,
    which is below the threshold, and nothing is kept."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: that with the largest id, a null id being less than any; of rows that
    repeat id and text one."""
    return exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints: that with the smallest id, as often as it is repeated; a
    null id stays only where all of its component are null."""
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item; one is enough to leak it.  An id goes with all its rows; an empty
    benchmark leaves every document."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; repeated rows each get their row."""
    return bpe.round_trip(docs.select("doc_id", "text"), vocabulary(), keep_text=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: The classifier, fingerprints and BPE are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's result is written to the shared folder, read again, and removed
    once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_dir(spark, before)
        before = path
    return docs

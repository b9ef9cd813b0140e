"""The corpus pipeline: language, exact and near duplicates, personal data, packing; each stage on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, language, near, packing, private
from tidemark.llm.common import table
from tidemark.llm.storing import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go (null texts, texts without a letter). Null ids, repeated rows and empty tables stay."""
    return language.identified(docs, language.prototypes(docs, F.lit(True)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the smallest id; of repeated rows one."""
    return exact.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, similarity 0.8), that with the smallest id; null ids and texts without words stay."""
    return near.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in brackets; every row stays."""
    return private.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in windows of 2048 ids; an empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: The stages are models, signatures and tokenizers; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to packed sequences in four stages: language ID, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first three return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common, jaccard, language, packing, pii


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or with less than 0.3 of their letters in spans of learned languages, go; lang becomes what most of the text
    says."""
    return language.keep_identified(docs, language.fit(docs.where(~common.held_out())))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of five-word shingles the smallest doc_id stays."""
    return jaccard.one_of_each(docs, rule=jaccard.Rule(words=5, percent=80))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that tell of it leave the texts; n_chars follows."""
    return pii.sanitise(docs, rule=pii.EVERY_WORD).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of ids in sequences of 2048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Models, component search and token packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first four return the
columns of ``documents``; the last adds how often a document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sealroute.llm import decontaminate, language, mixing, neardup, pii
from sealroute.llm.common import keep, table, work
from sealroute.session import attach


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or too unlike any known language go."""
    attach(spark)
    return language.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 4-word shingles, similarity from 0.8 on."""
    attach(spark)
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items, without the passages of items that they hold."""
    attach(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data."""
    attach(spark)
    return pii.without_personal_data(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies (times) and taken (words)."""
    attach(spark)
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mix),
]

#: No SQL form: language models, personal data and the mix are learned or solved by iteration.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    attach(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = work(docs, "pipeline")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), folder, name)
    return docs

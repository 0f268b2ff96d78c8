"""The corpus pipeline: quality classifier, near-duplicates, decontamination, secrets, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, near_dedup, quality_classifier, secret_scan, source_mix
from barloom.llm.shared import discard, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those of ``docs`` that have labels."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no item of ``benchmark`` contaminates."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text."""
    return secret_scan.redact(docs, secret_scan.infer(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return source_mix.mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("source_mix", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes Parquet to the shared folder, which the next reads and which goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
        docs = before = after
    return docs

"""A training corpus from raw documents, in stages that each read what the one before has kept.

quality rules -> near-duplicates -> benchmark decontamination -> personal data -> SentencePiece ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontamination, near_dedup, pii, quality_rules, sentencepiece_lattice
from quern.llm.common import dropped, made, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go; the others stay whole."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two or more benchmark items go; passages of one item are cut out."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    return pii.redacted(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents, and ids."""
    return sentencepiece_lattice.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece_ids),
]

#: Neither the span classifier nor the fold of pieces can be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table, and what its operators wrote for it, goes when the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        before = made()
        docs, path = written(stage(spark, docs, sf_dir), name)
        dropped(spark, *(made() - before - {path}), *last)
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents, in stages that each call one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import ngram_join, packing, pii, quality_classifier, quality_rules
from riskloom.session import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, _labels(spark, sf_dir)))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the boosted trees reject go."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, _labels(spark, sf_dir)))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with little padding."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify_quality), ("quality rules", apply_rules), ("n-gram Jaccard join", join_near_copies),
    ("personal data", redact_personal_data), ("packing", pack_sequences),
]
#: Learned models decide in two stages; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

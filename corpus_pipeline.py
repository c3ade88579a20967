"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import contamination, language, near_dedup, packing, quality
from lattica.llm._common import save, temporary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters, null texts among them, go."""
    return language.accept(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of importance resampling accepts; the labels table teaches what is good."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: that with the least doc_id."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words are windows of benchmark items; what they hold of windows of 13 words is cut out."""
    return contamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_words=12)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what goes from one to the next is a table in the shared folder. What a stage but the last saves for
    itself goes at its end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = save(stage(spark, docs, sf_dir), name, lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and tokenization are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None

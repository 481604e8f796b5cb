"""The corpus pipeline: stages over documents, each written as Parquet and read again for the next one.

Every stage takes (spark, docs, sf_dir), works on all rows it gets and returns the rows it keeps with the columns of
documents; the last one adds ``repeat``, the number of the copy of a document in the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import leaks, mixing, near_dedup, quality, secrets
from millrace.session import checkpoint_folder

# No SQL: near duplicates, edit distances and learned automata can't be expressed; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays."""
    return near_dedup.first_of_groups(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secrets.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights: every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage), ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's rows are a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = f"{folder}/{number}-{name}"
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs

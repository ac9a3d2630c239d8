"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes each
result as Parquet to the shared folder and reads it again for the next stage. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlark.llm import mixing, packing, quality, secrets, simhash
from loomlark.llm.queries import vocabulary
from loomlark.llm.shared import documents, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose quality is predicted as 0 go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each near-duplicate group stays, that with the smallest id."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: secrets are masked; every document stays."""
    return secrets.redact(docs)


def balance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each document stands as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces with their sequence and offset."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", deduplicate),
    ("secret_scans", clean),
    ("mixing_sources", balance),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

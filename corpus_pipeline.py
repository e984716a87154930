"""A corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing to target weights, byte-level BPE.

Each stage reads what its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, lsh_forest, mixing, quality
from tessera.llm.common import Scratch
from tessera.llm.queries import fresh_index, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality.keep(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    index = fresh_index(spark)
    kept = exact_dedup.keep_first(docs, index)
    index.remove(files=True)  # what is decided no longer reads it
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the least id stays."""
    return lsh_forest.keep_one(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or dropped if toxic, so that domains reach their target shares of tokens."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, digested, and the digest of what they decode to."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing to target weights", mixing_weights),
    ("byte-level BPE", byte_bpe),
]

#: SQL can express neither the fitted mixing nor the merges of BPE; tests/llm/test_pipeline.py checks by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
    return STAGES[-1][1](spark, docs, sf_dir)

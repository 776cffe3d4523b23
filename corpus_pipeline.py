"""From documents to packed training sequences, in four stages.

Each stage is written as Parquet and read again by the next one. The first three
return documents with all their columns; the last one returns packed pieces.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seedmill.functions.storage import materialize
from seedmill.llm import near_duplicates, packing, quality_rules, secret_ledger
from seedmill.session import ship_package

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from the labels."""
    ship_package(spark)
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least doc_id."""
    ship_package(spark)
    return near_duplicates.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    ship_package(spark)
    return secret_ledger.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("pack", pack)]

# Learned rules, sampled candidates and a tokenizer are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

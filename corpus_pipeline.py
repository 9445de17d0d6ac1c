"""The corpus pipeline: filter, remove near-duplicates, mask secrets, mix sources, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. ``run`` writes each stage's rows as Parquet to the shared folder before
the next one reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm import bpe, mixing, quality, secret_scan, simhash
from tallyguard.llm.queries import tokenizer_json
from tallyguard.plans.stage import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.mask_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, a document once per epoch that takes it."""
    return mixing.draw(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row of the mixture."""
    ids = bpe.encode(docs, tokenizer_json())
    return ids.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("simhash_dedup", without_near_duplicates),
    ("secret_scan", without_secrets),
    ("source_mix", mixed),
    ("bpe_encode", encoded),
]

ORACLE_SQL = None  # fingerprints and ids of a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

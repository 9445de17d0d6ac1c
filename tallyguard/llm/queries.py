"""The registered queries of this subpackage, each next to the SQL that checks it."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import stage
from . import (
    bpe,
    cover_tree,
    license_scan,
    mixing,
    oracles,
    phrases,
    pii,
    ppm,
    prefix_trie,
    quality,
    secret_scan,
    simhash,
    token_counts,
    urls,
)

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined in the order of the array."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> per base kind, base_sha256 and spans from an array of spans."""
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def tokenizer_json() -> str:
    """The tokenizer's file, from the folder in PUBLIC_TOKENIZERS or the installed package."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        path = os.path.join(folder, TOKENIZER)
    else:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as file:
        return file.read()


def _digested(decoded: Callable) -> Callable:
    """Decode batches of ids and keep digests: of the ids as little-endian unsigned 32-bit
    numbers, and of the decoded text."""

    def hashed(values: Iterator[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500))
        for batch in decoded(small):
            ids = [x.values.to_numpy().astype("<u4") for x in batch.column("ids")]
            columns = [
                batch.column("id"),
                pa.array([len(x) for x in ids], pa.int64()),
                hashed(x.tobytes() for x in ids),
                hashed(x.as_py() for x in batch.column("text").cast(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return work


@query("op1_bpe_roundtrip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_json()
    coded = bpe.encode(documents(spark, sf_dir), tokenizer)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return coded.mapInArrow(_digested(bpe.decoder(tokenizer)), schema)


@query("op2_mix_sources", oracles.MIX)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op3_pii_spans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


@query("op4_ppm_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query("op5_url_templates", oracles.URLS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return span_digest(found, secret_scan.BASE_KINDS)


@query("op7_license_scan", oracles.LICENSES)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["name"]), ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda x: x["containment"])).alias("best"),
    )


@query("op8_simhash_groups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op9_cover_tree", oracles.COVER_TREE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return cover_tree.near_duplicates(vectors).withColumnRenamed("id", "vec_id")


@query("op10_quality_rules", oracles.QUALITY)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(documents(spark, sf_dir), tokenizer_json())
    over = (F.col("n_tokens") > 1024).alias("over_limit")
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", over)


@query("op12_phrases", oracles.PHRASES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(documents(spark, sf_dir))
    return found.select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


@query("op13_prefix_trie", oracles.PREFIX_TRIE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = stage(prefix_trie.numbered_turns(conversations), "turns")
    rebuilt, members = prefix_trie.with_family_heads(turns)
    return prefix_trie.trie(stage(rebuilt, "turns-rebuilt"), members).select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )

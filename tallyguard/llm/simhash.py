"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 majority bits over the XXH64 values of a text's shingles of four words.
Search: every bit position gets a non-zero vector of radius + 1 bits; the mask of a table v
keeps the positions whose vector has an odd product with v. Up to ``radius`` differing
positions span a space that some v is orthogonal to, so in that table no differing position
is kept and the pair meets. With radius 4 there are 31 tables that keep about half the bits.

Equal fingerprints are one node before the search starts, so exact copies cost nothing. In a
bucket, sorted neighbours are linked first (linear work); most groups of near copies are one
component after that. Only buckets that still hold several components are compared in full:
small ones by a join, larger ones in square tiles of bounded size. What is left out are pairs
inside a component, which cannot change the result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import stage
from .components import components

BITS, SHINGLE, SEED = 64, 4, 42
JOINED = 16  # buckets up to this size are compared by a join
TILE = 2048  # nodes on either side of a comparison


def fingerprint(raw: bytes) -> int:
    """Majority bits of the shingle hashes; zero for a text without words."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
    hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, content, fp): one row per document.

    ``fp`` holds the 64 bits as a signed bigint, ``content`` is a hash that tells texts apart.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("text").cast(pa.binary())
            values = np.array([fingerprint(x.as_py() or b"") for x in raws], dtype=np.uint64)
            columns = [batch.column("id"), batch.column("content"), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "content", "fp"])

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), _content(text).alias("content"), F.col(text).alias("text")
    )
    return rows.mapInArrow(work, "id bigint, content bigint, fp bigint")


def _content(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks; any ``radius`` positions are all unset in one of them."""
    full = 2 ** (radius + 1)
    vectors = [1 + i % (full - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    kept = lambda v: sum(((vec & v).bit_count() & 1) << i for i, vec in enumerate(vectors))
    return [kept(v) for v in range(1, full)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _tile_links(radius: int):
    """Links between the components of one tile: for each node, one per other component near it."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        left = rows[rows["block"] == i]
        right = rows[rows["block"] == j] if i != j else left
        a, la = left["fp"].to_numpy().view(np.uint64), left["root"].to_numpy()
        b, lb = right["fp"].to_numpy().view(np.uint64), right["root"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for fp, root in zip(a, la):
            near = np.flatnonzero((lb != root) & (np.bitwise_count(b ^ fp) <= radius))
            if len(near):
                _, first = np.unique(lb[near], return_index=True)
                to = lb[near[first]]
                found.append((np.full(len(to), root), to))
        if not found:
            return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        out = pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})
        return out.drop_duplicates()

    return work


def near_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(node, root) for every fingerprint of ``nodes(fp)`` that has another within ``radius``.

    Exact: two fingerprints get one root if and only if a chain of links connects them.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    keys = nodes.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("v", "key"))
    shared = keys.groupBy("v", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # merged: Spark sizes an explode like its input, and would broadcast all tables of a middling one
    met = stage(keys.join(shared.hint("merge"), ["v", "key"]), "simhash-met")

    blocks = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    place = F.pmod(F.xxhash64("fp", "v"), blocks).cast("int")
    beside = Window.partitionBy("v", "key", "block").orderBy("fp")
    first = (
        met.withColumns({"blocks": blocks, "block": place})
        .withColumn("next", F.lead("fp").over(beside))
        .filter(_apart("fp", "next") <= radius)
    )
    early = components(first.select(F.col("fp").alias("a"), F.col("next").alias("b")))
    early = stage(early, "simhash-early")

    rooted = (
        met.join(early.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    mixed = (
        rooted.groupBy("v", "key")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        .filter("lo != hi")
        .select("v", "key")
    )
    open_rows = stage(rooted.join(mixed, ["v", "key"]), "simhash-open")

    few = open_rows.filter(F.col("n") <= JOINED)
    other = few.select("v", "key", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    joined = (
        few.join(other.hint("merge"), ["v", "key"])
        .filter((F.col("fp") < F.col("fp2")) & (F.col("root") != F.col("root2")) & (_apart("fp", "fp2") <= radius))
        .select(F.col("root").alias("a"), F.col("root2").alias("b"))
    )
    many = open_rows.filter(F.col("n") > JOINED).withColumns({"blocks": blocks, "block": place})
    tiles = many.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    tiled = tiles.groupBy("v", "key", "i", "j").applyInPandas(_tile_links(radius), "a bigint, b bigint")
    late = joined.unionByName(tiled)
    return components(early.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))


def simhash_components(
    docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, content, fp, root, component): ``component`` is the smallest id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id
    take part; a component without any id is null. Repeated ids give one row each. An empty
    table gives an empty result; other columns are not read. ``root`` is a fingerprint that
    names the component even where ids repeat.
    """
    marked = stage(fingerprints(docs, id_col, text), "simhash-fingerprints")
    groups = stage(marked.groupBy("fp").agg(F.min("id").alias("low")), "simhash-groups")
    linked = near_links(groups.select("fp"), radius)
    rooted = groups.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    rooted = stage(rooted, "simhash-rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("fp", "root", "component")
    return marked.join(named, "fp").select("id", "content", "fp", "root", "component")


def keep_first(
    docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, columns as they were.

    Rows without an id come last in their group. Rows that repeat both id and text are one
    document; rows that repeat an id with another text are judged by their text.
    """
    marked = simhash_components(docs, radius, id_col, text)
    first = marked.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("late"), "id", "content")).alias("first")
    )
    chosen = first.select(_name("first.id").alias("_id"), F.col("first.content").alias("_content"))
    own = docs.columns
    found = docs.toDF(*[f"_{i}" for i in range(len(own))])
    at = lambda name: f"_{own.index(name)}"
    keyed = found.withColumns({"_id": _name(at(id_col)), "_content": _content(at(text))})
    kept = keyed.join(chosen, ["_id", "_content"], "left_semi")
    # the join has brought equal rows together, so numbering them moves nothing
    copy = F.row_number().over(Window.partitionBy("_id", "_content").orderBy("_id", "_content"))
    single = kept.withColumn("_copy", copy).filter("_copy = 1")
    return single.drop("_id", "_content", "_copy").toDF(*own)


def _name(id_col: str) -> Column:
    """The id as a text that is never null, for joins on equality."""
    return F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit("none"))

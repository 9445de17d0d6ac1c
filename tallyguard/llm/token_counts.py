"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded whole by the task that read it. A huge one is cut
into chunks that overlap; the chunks are dealt over all tasks and encoded on their own, with the
offsets of every pre-token and the tokens before it. Neighbours are then spliced at a common
boundary inside their overlap.

Why a common boundary is stable: a byte-level BPE tokenizer cuts a text into pre-tokens from left
to right, without looking back, and no merge crosses a pre-token. From a boundary on, the rest is
encoded alike whatever came before. So if the left chunk's boundaries are those of the whole text
and the right chunk has one of them too, the right chunk's boundaries after it are also those of
the whole text; the first chunk starts at zero, the rest follows chunk by chunk. A boundary that
lies closer to the end of the left chunk than the longest special token and contraction is not
used, as characters behind the end could have moved it.

Where an overlap holds no common boundary (a pre-token longer than the overlap, for instance), it
is widened until it covers the neighbour: the chunks beside it are joined, encoded again and
compared with their new neighbours, until every junction has a boundary. What one task holds is
thus at most the longest pre-token and a chunk on either side of it.

The tokens of a pre-token are counted once per task and kept in a table of bounded size.

A null text is an empty one and has no tokens. Ids may be of any type, null or repeated; every row
gives one row, equal rows equal counts. Other columns are not read. An empty table gives an empty
one. Tokenizers that are not plain byte-level BPE raise ValueError.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import stage
from .bpe import newer_characters, pieces, splitter

CHUNK = 1 << 15  # characters
OVERLAP = 256  # characters on either side of a cut
KNOWN = 1 << 19  # pre-tokens whose counts a task keeps
LONGEST = 64  # longer pre-tokens are counted each time
CONTRACTION = 3  # characters that decide whether a pre-token ends

_PIECE = (
    T.StructType()
    .add("key", "long")
    .add("piece", "long")
    .add("start", "long")
    .add("last", "boolean")
    .add("body", "string")
)
_CODED = (
    T.StructType()
    .add("key", "long")
    .add("piece", "long")
    .add("last", "boolean")
    .add("total", "long")
    .add("head_at", T.ArrayType(T.LongType()))
    .add("head_n", T.ArrayType(T.LongType()))
    .add("tail_at", T.ArrayType(T.LongType()))
    .add("tail_n", T.ArrayType(T.LongType()))
)


class _Counter:
    """Pre-tokens of a text and their numbers of tokens."""

    def __init__(self, tokenizer_json: str, new: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.split: Callable[[str], list[str]] = splitter(special, new)
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> Iterator[int]:
        """Tokens of every word in order."""
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, list(set(words))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update(zip(some, map(len, coded)))
        found = map(self.known.__getitem__, words)
        if any(len(w) > LONGEST for w in new):
            found = iter(list(found))
            for word in new:
                if len(word) > LONGEST:
                    del self.known[word]
        return found


def _cut(tokenizer_json: str, new: str, chunk: int, overlap: int):
    """Count texts of one chunk, cut the others."""

    def rows(batch: pa.RecordBatch, counter: _Counter, seen: int) -> Iterator[tuple]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        for i, text in enumerate(batch.column("text")):
            text = text.as_py() or ""
            if len(text) <= chunk:
                yield i, sum(counter.counts(counter.split(text))), None, None, None, None, None
                continue
            key = base + seen + i
            cuts = range(chunk, len(text), chunk)
            yield i, None, key, None, None, None, None
            for piece in range(len(cuts) + 1):
                start = max(0, piece * chunk - overlap)
                end = (piece + 1) * chunk + overlap
                yield None, None, key, piece, start, piece == len(cuts), text[start:end]

    def close(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        places, counts, *rest = zip(*found)
        at = pa.array(list(places), pa.int64())
        own = [batch.column(n).take(at) for n in ("id", "n_bytes")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        columns = [pa.array(list(c), k) for c, k in zip(rest, kinds)]
        names = ["id", "n_bytes", "n_tokens", *_PIECE.fieldNames()]
        return pa.RecordBatch.from_arrays([*own, pa.array(list(counts), pa.int64()), *columns], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = _Counter(tokenizer_json, new), 0
        for batch in batches:
            found, held = [], 0
            for row in rows(batch, counter, seen):
                found.append(row)
                held += len(row[-1] or "")
                if held > 1 << 22:
                    yield close(batch, found)
                    found, held = [], 0
            if found:
                yield close(batch, found)
            seen += batch.num_rows

    return work


def _encode(tokenizer_json: str, new: str, overlap: int, margin: int):
    """Tokens of every piece, and where its pre-tokens begin in its two overlaps."""

    def one(counter: _Counter, start: int, body: str) -> tuple:
        words = counter.split(body)
        tokens = np.fromiter(counter.counts(words), np.int64, len(words))
        at = start + np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        before = np.concatenate([[0], np.cumsum(tokens)])
        head = at <= start + 2 * overlap
        end = start + len(body)
        tail = (at >= end - 2 * overlap) & (at <= end - margin)
        return int(before[-1]), at[head], before[head], at[tail], before[tail]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(tokenizer_json, new)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                starts, bodies = part.column("start").to_pylist(), part.column("body")
                coded = [one(counter, s, b.as_py()) for s, b in zip(starts, bodies)]
                total, *lists = zip(*coded)
                columns = [part.column(n) for n in ("key", "piece", "last")]
                columns += [pa.array(list(total), pa.int64())]
                columns += [pa.array(list(x), pa.list_(pa.int64())) for x in lists]
                yield pa.RecordBatch.from_arrays(columns, _CODED.fieldNames())

    return work


def _count_before(at: str, n: str, position: Column) -> Column:
    return F.element_at(n, F.array_position(at, position).cast("int"))


def _junctions(coded: DataFrame) -> DataFrame:
    """One row per cut: ``left`` and ``right`` piece, and the tokens of the left piece before the
    last common boundary less those of the right piece before it; null where there is none."""
    order = Window.partitionBy("key").orderBy("piece")
    nexts = coded.select("key", "piece", F.lead("piece").over(order).alias("next")).filter("next IS NOT NULL")
    left = coded.select("key", "piece", "tail_at", "tail_n")
    right = coded.select("key", F.col("piece").alias("next"), "head_at", "head_n")
    p = F.array_max(F.array_intersect("tail_at", "head_at"))
    both = left.join(nexts, ["key", "piece"]).join(right, ["key", "next"]).withColumn("p", p)
    gain = _count_before("tail_at", "tail_n", F.col("p")) - _count_before("head_at", "head_n", F.col("p"))
    return both.select("key", "piece", "next", gain.alias("gain"))


def _joined(parts: DataFrame, failed: DataFrame) -> DataFrame:
    """Pieces on both sides of failed junctions, joined to one piece each."""
    bad = failed.select("key", F.col("next").alias("piece"), F.lit(True).alias("goes_on"))
    sides = failed.select("key", "piece").union(failed.select("key", "next")).distinct()
    near = parts.join(sides, ["key", "piece"], "left_semi").join(bad, ["key", "piece"], "left")
    begins = F.sum(F.when(F.col("goes_on"), 0).otherwise(1))
    order = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    runs = near.withColumn("run", begins.over(order))

    def join(group: pa.Table) -> pa.Table:
        rows = group.sort_by("piece").to_pylist()
        body, end = [rows[0]["body"]], rows[0]["start"] + len(rows[0]["body"])
        for row in rows[1:]:
            body.append(row["body"][end - row["start"] :])
            end = row["start"] + len(row["body"])
        whole = {**rows[0], "last": rows[-1]["last"], "body": "".join(body)}
        return pa.Table.from_pylist([{n: whole[n] for n in _PIECE.fieldNames()}], _ARROW)

    return runs.groupBy("key", "run").applyInArrow(join, _PIECE)


_ARROW = pa.schema(
    [("key", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("body", pa.string())]
)


def _spliced(parts: DataFrame, encode: Callable, name: str) -> DataFrame:
    """(key, n_tokens) of the texts whose pieces these are."""
    deal = lambda p: p.repartition("key", "piece").mapInArrow(encode, _CODED)
    coded = stage(deal(parts), f"{name}-coded")
    while True:
        junctions = stage(_junctions(coded), f"{name}-junctions")
        failed = junctions.filter("gain IS NULL")
        if failed.isEmpty():
            break
        whole = stage(_joined(parts, failed), f"{name}-joined")
        gone = failed.select("key", "piece").union(failed.select("key", "next")).distinct()
        parts = stage(
            parts.join(gone, ["key", "piece"], "left_anti").select(*_PIECE.fieldNames()).unionByName(whole),
            f"{name}-pieces",
        )
        others = coded.join(gone, ["key", "piece"], "left_anti").select(*_CODED.fieldNames())
        coded = stage(others.unionByName(deal(whole)), f"{name}-coded")
    ends = coded.filter("last").select("key", F.col("total").alias("gain"))
    return junctions.select("key", "gain").unionByName(ends).groupBy("key").agg(F.sum("gain").alias("spliced"))


def count(
    docs: DataFrame,
    tokenizer_json: str,
    id_col: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: UTF-8 bytes and tokens of its whole text.

    ``chunk`` and ``overlap`` (both in characters) steer the work, never the counts.
    """
    import json

    pieces(tokenizer_json)  # refuses other kinds of tokenizers
    special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
    margin = CONTRACTION + max(map(len, special), default=0)
    if 2 * overlap <= margin or chunk <= 2 * overlap + margin:
        raise ValueError("the overlap must hold a special token, a chunk more than its two overlaps")
    new = newer_characters(tokenizer_json)
    size = F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), size.alias("n_bytes"), F.col(text).alias("text"))
    own = T.StructType().add("id", rows.schema["id"].dataType).add("n_bytes", "long").add("n_tokens", "long")
    schema = T.StructType([*own.fields, *_PIECE.fields])
    cut = stage(rows.mapInArrow(_cut(tokenizer_json, new, chunk, overlap), schema), "token-counts")
    parts = cut.filter("piece IS NOT NULL").select(*_PIECE.fieldNames())
    spliced = _spliced(parts, _encode(tokenizer_json, new, overlap, margin), "token")
    whole = cut.filter("piece IS NULL").select("id", "n_bytes", "n_tokens", "key")
    return whole.join(spliced, "key", "left").select(
        "id", "n_bytes", F.coalesce("n_tokens", "spliced").alias("n_tokens")
    )

"""Distinct-word tables over blocks of documents, and values joined back by position.

A block is a run of documents that one task has read, up to a fixed amount of text. It keeps
the distinct words once, numbered by frequency, and each document as a sequence of numbers.
The words of all blocks are dealt to shards by their hash; a shard holds the table of its
distinct words, finds a value for each word once, and answers every block in the order in
which the block listed its words. A block then reads the values of its documents by position.

A word reaches the shuffle once per block however often the block repeats it, so frequent
words cost no more than rare ones. The number of shards follows the amount of text, blocks
have a fixed size: no task grows with the corpus.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage_root

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 48 << 20  # text per shard; its distinct words are a small part of that


def shard_count(docs: DataFrame, text: str, shard_bytes: int = SHARD_BYTES) -> int:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return 1 + int(size // shard_bytes)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers, seven bits a byte, the first bytes of all before the second ones."""
    rest, planes = values.astype(np.uint64), []
    while len(rest):
        more = rest > 127
        planes.append(((rest & 127) | (more.astype(np.uint64) << 7)).astype(np.uint8).tobytes())
        rest = rest[more] >> 7
    return struct.pack("<q", len(values)) + b"".join(planes)


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Compressed arrays of unsigned numbers and raw bytes."""
    import zstandard

    out = []
    for part in parts:
        if isinstance(part, np.ndarray):
            part = _planes(part)
        out += [struct.pack("<q", len(part)), part]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(payload: bytes) -> list[bytes]:
    import zstandard

    whole, at, parts = zstandard.ZstdDecompressor().decompress(payload), 0, []
    while at < len(whole):
        (size,) = struct.unpack_from("<q", whole, at)
        parts.append(whole[at + 8 : at + 8 + size])
        at += 8 + size
    return parts


def numbers(part: bytes) -> np.ndarray:
    """The unsigned 32-bit numbers of a part that was packed as an array."""
    (size,) = struct.unpack_from("<q", part)
    values, where, at, shift = np.zeros(size, np.uint32), np.arange(size), 8, 0
    while len(where):
        plane = np.frombuffer(part, np.uint8, len(where), at)
        values[where] |= (plane & 127).astype(np.uint32) << shift
        at, shift, where = at + len(where), shift + 7, where[plane > 127]
    return values


def pack_words(words: list[bytes], *columns: np.ndarray) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return pack(lengths, b"".join(words), *columns)


def unpack_words(payload: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    lengths, joined, *columns = unpack(payload)
    ends = np.cumsum(numbers(lengths), dtype=np.int64).tolist()
    words = [joined[s:e] for s, e in zip([0, *ends], ends)]
    return words, [numbers(c) for c in columns]


def stage_blocks(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """Write rows of blocks to the shared folder, bucketed by ``block``.

    What is gathered per block later meets these rows where they lie; they are never shuffled.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{stage_root(rows.sparkSession)}/tallyguard-{rows.sparkSession.sparkContext.applicationId}/{table}"
    rows.write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def block_name(seen: int) -> int:
    """A number no other block of the same job has."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + seen


def by_frequency(sequence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sequence): old numbers by falling frequency, and the sequence in new numbers."""
    order = np.argsort(-np.bincount(sequence, minlength=size), kind="stable")
    place = np.empty(size, np.uint32)
    place[order] = np.arange(size, dtype=np.uint32)
    return order, place[sequence] if len(sequence) else sequence


def dealt(words: list[bytes], shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of its words in the list) for every shard that has any."""
    shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.int64, len(words))
    order = np.argsort(shard, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(own):
            yield int(shard[own[0]]), own


def gather(flat: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ragged rows of ``flat`` (row i ends at ends[i]) in the order ``chosen``.

    Returns the values and the length of each chosen row.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lengths = (ends - starts)[chosen]
    total = int(lengths.sum())
    shift = np.repeat(starts[chosen] - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)], lengths

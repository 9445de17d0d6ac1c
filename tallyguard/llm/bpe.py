"""Byte-level BPE: encode each distinct word once, join ids back by position, decode by pieces.

Texts are split into words in Spark tasks with the tokenizer's own pattern. The distinct words
of all texts form a table, sharded by hash; the merges run once per distinct word in it, and
the ids return to the blocks of documents that hold the word (see ``blocks``). Words never
cross a merge, so the ids of a text are those of its words in order. Special tokens that occur
in a text are cut out first, as the tokenizer does.

Decoding looks ids up in the id-to-piece table, an array as large as the vocabulary and no
larger that is shipped with the task (no DataFrame join), and concatenates the pieces' bytes;
invalid UTF-8 is replaced.

The tokenizer is a parameter: the text of its JSON file, read on the driver. Supported are
byte-level BPE tokenizers without a normalizer, a post-processor or a prefix space; others
raise ValueError.

A null text is an empty text: no ids, decoded to an empty text. Ids of documents may repeat or
be null; each row gives one row. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import (
    BLOCK_BYTES,
    SHARD_BYTES,
    block_name,
    by_frequency,
    dealt,
    gather,
    numbers,
    pack,
    pack_words,
    shard_count,
    stage_blocks,
    unpack,
    unpack_words,
)

# Fixed value: the pattern of byte-level BPE pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same where some characters, put in for NEW, are neither letters nor numbers.
OLDER = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[NEW]]+| ?[\p{N}--[NEW]]+"
    r"| ?(?:[^\s\p{L}\p{N}]|[NEW])+|\s+(?!\S)|\s+"
)

_AT_ONCE = 1 << 18  # words whose ids are joined back at once

_SPLIT = "block bigint, ids array<bigint>, lengths array<int>, sequence binary, shard int, words binary"
_IDS = "block bigint, coded binary"


def _checked(tokenizer_json: str) -> dict:
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    plain = (
        spec["model"]["type"] == "BPE"
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not spec.get("normalizer")
        and not spec.get("post_processor")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )
    if not plain:
        raise ValueError("only plain byte-level BPE tokenizers are supported")
    return spec


def newer_characters(tokenizer_json: str) -> str:
    """Ranges of characters that are letters or numbers here and not to the tokenizer.

    The two know different versions of Unicode; each character is put to the tokenizer once.
    """
    import regex
    from tokenizers import Tokenizer

    pre = Tokenizer.from_str(tokenizer_json).pre_tokenizer
    every = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000)
    new: list[int] = []
    for kind, like in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        asked = regex.findall(kind, every)
        pieces = pre.pre_tokenize_str("\n".join(like + c for c in asked))
        starts = {at for _, (at, _) in pieces}
        new += [ord(c) for i, c in enumerate(asked) if 3 * i + 1 in starts]
    points = np.array(sorted(new), np.int64)
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1) if len(points) else []
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


def _latin() -> Callable[[str], list[str]]:
    """Words of a text whose characters are all below 256: the classes listed one by one, which
    the plain expression engine scans faster. A word that begins with an apostrophe is a
    contraction first, so contractions may stand after the classes they cannot begin with."""
    import regex

    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(kind, chr(c)))
    letter, number, space = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    pattern = (
        f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{letter}{number}{space}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )
    return re.compile(pattern).findall


def splitter(special: list[str], new: str = "") -> Callable[[str], list[str]]:
    """A function from a text to its words, special tokens among them as words.

    ``new`` are the ranges of :func:`newer_characters`.
    """
    import regex

    latin, plain = _latin(), regex.compile(PATTERN).findall
    any_new = regex.compile(f"[{new}]").search if new else lambda text: None
    older = regex.compile(OLDER.replace("NEW", new), regex.VERSION1).findall if new else plain

    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return older(text) if any_new(text) else plain(text)
        return latin(text)

    if not special:
        return words
    longest = sorted(special, key=len, reverse=True)
    cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")")

    def split(text: str) -> list[str]:
        if not any(token in text for token in special):
            return words(text)
        out: list[str] = []
        for i, part in enumerate(cut.split(text)):
            out += [part] if i % 2 else words(part)
        return out

    return split


def _numbering() -> dict:
    """A table that gives every new key the next number."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    return index


def _split_blocks(special: list[str], new: str, shards: int, block_bytes: int):
    """Rows of blocks (ids, lengths, sequence) and rows of their words by shard."""

    def close(name: int, ids: list, parts: list[np.ndarray], index: dict[str, int]) -> pa.RecordBatch:
        sequence = np.concatenate(parts) if parts else np.array([], np.uint32)
        order, sequence = by_frequency(sequence, len(index))
        listed = list(index)
        words = [listed[i].encode() for i in order.tolist()]
        rows = [(name, ids, [len(p) for p in parts], pack(sequence), None, None)]
        for shard, own in dealt(words, shards):
            gaps = np.diff(own, prepend=0)
            rows.append((name, None, None, None, shard, pack_words([words[i] for i in own], gaps)))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary())
        names = ("block", "ids", "lengths", "sequence", "shard", "words")
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=list(names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, held = splitter(special, new), 0, 0
        ids: list = []
        parts: list[np.ndarray] = []
        index = _numbering()
        for batch in batches:
            for doc, text in zip(batch.column("id"), batch.column("text")):
                text = text.as_py() or ""
                words = split(text)
                parts.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                ids.append(doc.as_py())
                held += len(text)
                if held >= block_bytes:
                    yield close(block_name(seen), ids, parts, index)
                    ids, parts, index, held, seen = [], [], _numbering(), 0, seen + 1
        if ids:
            yield close(block_name(seen), ids, parts, index)

    return work


def _encode_shard(tokenizer_json: str):
    """Ids of the distinct words of a shard, found once, for every block that lists the word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        index, flat, ends = _numbering(), np.array([], np.uint32), np.array([], np.int64)
        for batch in batches:
            for block, payload in zip(batch.column("block"), batch.column("words")):
                words, (gaps,) = unpack_words(payload.as_py())
                known = len(index)
                number = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                new = [w.decode() for w in islice(reversed(index), len(index) - known)][::-1]
                for start in range(0, len(new), 10_000):
                    coded = tokenizer.encode_batch(new[start : start + 10_000], add_special_tokens=False)
                    ids = [c.ids for c in coded]
                    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                    ends = np.concatenate([ends, len(flat) + np.cumsum(sizes)])
                    flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
                answer = pack(gaps, *reversed(gather(flat, ends, number)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()], pa.int64()), pa.array([answer], pa.binary())],
                    names=["block", "coded"],
                )

    return work


def _join_back(blocks: pa.Table, coded: pa.Table) -> pa.Table:
    """(id, ids) of every document of a block, by position."""
    places, sizes, flats = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([], np.uint32)]
    for payload in coded.column("coded"):
        gaps, size, flat = map(numbers, unpack(payload.as_py()))
        places.append(np.cumsum(gaps.astype(np.int64)))
        sizes.append(size.astype(np.int64))
        flats.append(flat)
    order = np.argsort(np.concatenate(places))
    flat, sizes = np.concatenate(flats), np.concatenate(sizes)
    by_place, sizes = gather(flat, np.cumsum(sizes), order)
    ends = np.cumsum(sizes)
    sequence = numbers(unpack(blocks.column("sequence")[0].as_py())[0])
    ids = blocks.column("ids")[0].values
    words = np.concatenate([[0], np.cumsum(np.array(blocks.column("lengths")[0].as_py(), np.int64))])
    parts, first = [], 0
    while first < len(ids):  # some documents at a time, for little memory beside the result
        last = max(first + 1, int(np.searchsorted(words, words[first] + _AT_ONCE, "right")) - 1)
        tokens, per_word = gather(by_place, ends, sequence[words[first] : words[last]])
        cuts = np.concatenate([[0], np.cumsum(per_word)])[words[first : last + 1] - words[first]]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(tokens.astype(np.int32)))
        parts.append(pa.table({"id": ids.slice(first, last - first), "ids": lists}))
        first = last
    return pa.concat_tables(parts)


def encode(
    docs: DataFrame,
    tokenizer_json: str,
    id_col: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(id, ids): the ids of every text, as the tokenizer gives them without special tokens added."""
    special = [t["content"] for t in _checked(tokenizer_json)["added_tokens"]]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    shards = shard_count(rows, "text", shard_bytes)
    work = _split_blocks(special, newer_characters(tokenizer_json), shards, block_bytes)
    split = stage_blocks(rows.mapInArrow(work, _SPLIT), shards, "bpe_blocks")
    words = split.filter("shard IS NOT NULL").select("block", "shard", "words")
    coded = words.groupBy("shard").applyInArrow(_encode_shard(tokenizer_json), _IDS)
    blocks = split.filter("shard IS NULL").select("block", "ids", "lengths", "sequence")
    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(
        _join_back, "id bigint, ids array<int>"
    )


def pieces(tokenizer_json: str) -> list[bytes]:
    """The bytes of every id; the table is as large as the vocabulary."""
    spec = _checked(tokenizer_json)
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others
    # follow from code point 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    named = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    table = [b""] * (1 + max(named.values()))
    for name, number in named.items():
        known = all(c in byte_of for c in name)
        table[number] = bytes(byte_of[c] for c in name) if known else name.encode()
    return table


def decoder(tokenizer_json: str, ids: str = "ids", out: str = "text"):
    """A function on batches that adds the text of each array of ids."""
    table = pieces(tokenizer_json)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = np.array(table, dtype=object)
        for batch in batches:
            lists = [x.values.to_numpy() if x.is_valid else [] for x in batch.column(ids)]
            texts = [b"".join(piece[x].tolist()).decode("utf-8", "replace") if len(x) else "" for x in lists]
            yield batch.append_column(out, pa.array(texts, pa.string()))

    return work


def decode(encoded: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of each array of ids, special tokens included; null ids give an empty text."""
    plain = encoded.drop(out)
    schema = T.StructType([*plain.schema.fields, T.StructField(out, T.StringType())])
    return plain.mapInArrow(decoder(tokenizer_json, ids, out), schema)

"""Secrets in texts: a keyword automaton first, anchored expressions near its hits, checksums last.

One pass of an Aho-Corasick automaton over the lower-cased bytes finds the places where a
secret can begin; regular expressions are tried only there, anchored. Tokens of a format that
carries its own checksum are accepted only if the checksum holds. Strings of hexadecimal
digits have no keyword: a run of sixteen digits is itself the anchor.

Kinds: ``assign`` (a password or key that is assigned), ``access`` (access key ids), ``hex``
(long hexadecimal strings) and, beyond those, ``checked`` (tokens with a valid checksum).
Spans are in code points, end exclusive, ordered by start and then by kind.

A null text has no spans and stays null. Texts are scanned whole. Extra columns stay; a column
that bears the name of the added one is replaced. Rows are independent: repeated rows give
repeated results, an empty table an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The keywords, the patterns and the token formats that are looked for.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_WORD, ACCESS = "akia", rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{16,}"
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "checked")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)


def checksum(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of a token's body."""
    value, digits = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit : digit + 1] + digits
    return digits


def scanner() -> Callable[[bytes], list[tuple[int, int, int]]]:
    """A function from the bytes of a text to (start, kind number, end) in bytes, ordered."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, found in ((0, ASSIGN_WORDS), (1, (ACCESS_WORD,)), (3, CHECKED_WORDS)):
        for word in found:
            automaton.add_word(word, (kind, len(word) - 1))
    automaton.make_automaton()
    anchored = {
        0: (re.compile(ASSIGN, re.IGNORECASE), lambda m: len(m[2]) >= 12),
        1: (re.compile(ACCESS), lambda m: len(m[0]) >= 18),
        3: (re.compile(CHECKED), lambda m: checksum(m[1]) == m[2]),
    }
    hexadecimal = re.compile(HEX)

    def scan(raw: bytes) -> list[tuple[int, int, int]]:
        spans = [(m.start(), 2, m.end()) for m in hexadecimal.finditer(raw)]
        hits = [(at - back, kind) for at, (kind, back) in automaton.iter(raw.lower().decode("latin-1"))]
        done = [0] * len(KINDS)  # leftmost, non-overlapping, for each kind by itself
        for start, kind in sorted(hits):
            pattern, valid = anchored[kind]
            if start >= done[kind] and (m := pattern.match(raw, start)):
                done[kind] = m.end()
                if valid(m):
                    spans.append((start, kind, m.end()))
        return sorted(spans)

    return scan


def _code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    if raw.isascii():
        at = lambda i: i
    else:
        begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(begins)])
        at = lambda i: int(before[i])
    return [{"kind": KINDS[k], "start": at(s), "end": at(e)} for s, k, e in spans]


def _masked(raw: bytes, spans: list[tuple[int, int, int]], mask: bytes) -> bytes:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [raw[at:start], mask]
        at = max(at, end)
    return b"".join([*out, raw[at:]])


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = batch.schema.names
    if name in names:
        return batch.set_column(names.index(name), name, values)
    return batch.append_column(name, values)


def _schema(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name not in docs.columns:
        return T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    return T.StructType(
        [T.StructField(name, kind) if f.name == name else f for f in docs.schema.fields]
    )


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add the array of (kind, start, end) found in each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        for batch in batches:
            raws = batch.column(text).cast(pa.binary())
            found = [[] if (raw := x.as_py()) is None else _code_points(raw, find(raw)) for x in raws]
            yield _put(batch, out, pa.array(found, pa.list_(_SPAN)))

    return docs.mapInArrow(work, _schema(docs, out, SPANS))


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows with every found span replaced; overlapping spans become one mask.

    A column ``n_chars`` is set to the length of the new text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, put = scanner(), mask.encode()
        for batch in batches:
            raws = [x.as_py() for x in batch.column(text).cast(pa.binary())]
            clean = [raw and _masked(raw, find(raw), put) for raw in raws]
            yield _put(batch, text, pa.array(clean, pa.binary()).cast(pa.string()))

    out = docs.mapInArrow(work, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length(text).cast(kind))
    return out

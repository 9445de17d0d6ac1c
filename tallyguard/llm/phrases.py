"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased and laid out in blocks: the words of one group (language) and one task,
joined by single spaces, a line for each piece. In a block, prefix polynomials over its bytes give
the fingerprint of every n-gram as a difference of two prefixes, all n-grams at once in numpy. A
shuffle adds up the fingerprints of all blocks; each comes with a pointer to an occurrence (block
and place). Words and pairs come first, then one length after the other: an n-gram is fingerprinted only
where both n-grams of one word less in it are frequent, which loses none, as a phrase is never more
frequent than its parts. (Pairs of frequent words alone would be a fifth fewer, less than it costs
to bring marks and text together once more.)

Fingerprints only select: equal phrases have equal ones, so no frequent phrase is missed. Then
every block compares the occurrences of a selected fingerprint with the text at its pointer, byte
by byte, sets apart those that differ, and materialises each selected phrase once. Counts are
summed again over these texts and are exact whatever collides.

A phrase is scored at each cut into a first and a second part, ``floor(10**6 a a / (l r))`` with the
counts a of the phrase and l, r of its parts; its lowest score counts. Products are decimals of 38
digits. A phrase that a longer frequent one mostly covers is dropped.

Null texts are empty, a null group is ``und``; texts without words add nothing. Repeated rows count
as often as they occur. Other columns are not read. An empty table gives an empty one. Groups that
hold any part of the rows are many blocks; a block has at most ``BLOCK_BYTES`` and one text more.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import setting as _setting
from ..plans.stage import shuffles_removed as _shuffles_removed
from ..plans.stage import stage

NO_GROUP = "und"
BLOCK_BYTES = 6 << 20
SEGMENT = 1 << 18  # bytes whose prefix polynomial is held at once
AT_ONCE = 1 << 16  # phrases that are compared or materialised at once
TOP_ROWS = 1_000_000  # rows among which one task finds the first ones

# Fixed values of the definition: characters that end a piece, and characters that end a word.
_PIECE_ENDS, _WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes.maketrans(
    bytes(range(65, 91)) + _PIECE_ENDS + _WORD_ENDS,
    bytes(range(97, 123)) + b"\n" * len(_PIECE_ENDS) + b" " * len(_WORD_ENDS),
)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

# an occurrence has a fingerprint and a pointer (block, at), a text its group and phrase
_FIELDS = [
    ("words", pa.int32()),
    ("n", pa.int64()),
    ("fp", pa.int64()),
    ("block", pa.int64()),
    ("at", pa.int64()),
    ("grp", pa.string()),
    ("phrase", pa.string()),
]
_SCHEMA = pa.schema(_FIELDS)
_ROWS = "words int, n bigint, fp bigint, block bigint, at bigint, grp string, phrase string"


def normalised(raw: bytes) -> bytes:
    """The words of a text, each followed by one space, or by a line end where its piece ends."""
    a = np.frombuffer(raw.translate(_PLAIN) + b"\n", np.uint8)
    word = (a != 32) & (a != 10)
    after = np.zeros(len(a), bool)
    after[1:] = word[:-1] & ~word[1:]  # the first character behind each word
    lines = np.cumsum(a == 10)
    ends = np.flatnonzero(after)
    begins = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    ends_piece = np.ones(len(ends), bool)
    if len(ends) > 1:
        ends_piece[:-1] = lines[begins[1:]] > lines[ends[:-1] - 1]
    out = a.copy()
    out[ends] = np.where(ends_piece, 10, 32)
    return out[word | after].tobytes()


@functools.lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """All bits of a polynomial spread over the fingerprint, apart for each salt."""
    x = values ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class Block:
    """The words of a block: where they start and end, and where a piece ends behind one."""

    def __init__(self, group: str, body: bytes | pa.Buffer):
        self.group = group
        self.raw = np.frombuffer(body, np.uint8)
        self.ends = np.flatnonzero((self.raw == 32) | (self.raw == 10)).astype(np.int32)
        self.starts = np.concatenate([np.zeros(1, np.int32), self.ends[:-1] + 1])[: len(self.ends)]
        self.stops = self.raw[self.ends] == 10

    def places(self, n: int) -> np.ndarray:
        """Words at which an n-gram within a piece begins, as a mask."""
        size = len(self.ends)
        ok = np.zeros(size, bool)
        if size >= n:
            ok[: size - n + 1] = True
            for i in range(n - 1):
                ok[: size - i] &= ~self.stops[i:]
        return ok

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams that begin at the words ``at`` (rising)."""
        salt = hashlib.blake2b(f"{n}:{self.group}".encode(), digest_size=8).digest()
        out = np.empty(len(at), np.uint64)
        starts, ends = self.starts[at], self.ends[at + n - 1]
        first = 0
        while first < len(at):
            origin = starts[first]
            last = max(first + 1, int(np.searchsorted(starts, origin + SEGMENT)))
            stop = int(ends[last - 1])  # ends rise with the words
            size = 1 << int(stop - origin + 1).bit_length()
            up, down = _powers(size, _BASE), _powers(size, _INVERSE)
            terms = (self.raw[origin:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - origin]
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            s, e = starts[first:last] - origin, ends[first:last] - origin
            out[first:last] = (prefix[e] - prefix[s]) * down[s]
            first = last
        return _mixed(out, int.from_bytes(salt, "little"))

    def bytes_of(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, lengths) of the phrases at ``at``, one after the other."""
        starts = self.starts[at]
        lengths = self.ends[at + n - 1] - starts
        shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        return self.raw[shift + np.arange(int(lengths.sum()))], lengths


def _lay_out(block_bytes: int):
    """Rows (grp, text) to blocks (block, grp, words, body)."""

    def row(name: int, group: str, texts: list[bytes]) -> pa.RecordBatch:
        body = normalised(b"\n".join(texts))
        words = body.count(b" ") + body.count(b"\n")
        columns = [pa.array([name], pa.int64()), pa.array([group]), pa.array([words], pa.int64())]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([body], pa.binary())], ["block", "grp", "words", "body"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for group, text in zip(batch.column("grp").to_pylist(), texts):
                raw = text.as_py()
                if not raw:
                    continue
                held.setdefault(group, []).append(raw)
                sizes[group] = sizes.get(group, 0) + len(raw)
                total += len(raw)
                while sizes.get(group, 0) >= block_bytes or total >= 4 * block_bytes:
                    full = group if sizes.get(group, 0) >= block_bytes else max(sizes, key=sizes.__getitem__)
                    total -= sizes.pop(full)
                    yield row(name, full, held.pop(full))
                    name += 1
        for group, texts in held.items():
            yield row(name, group, texts)
            name += 1

    return work


def blocks(
    docs: DataFrame, text: str = "text", group: str = "lang", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(block, grp, words, body): all texts, laid out in blocks and written to the shared folder."""
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP)).alias("grp"), F.col(text).alias("text"))
    laid = rows.mapInArrow(_lay_out(block_bytes), "block bigint, grp string, words bigint, body binary")
    # bodies are large values, which this codec reads as a stream and not in buffers of their size
    with _setting(docs.sparkSession, "spark.sql.parquet.compression.codec", "zstd"):
        return stage(laid.filter("words > 0"), "phrase-blocks")


def _rows(size: int, **columns) -> pa.Table:
    """Rows of the common schema, in small batches; columns that are not given are null."""
    given = [pa.array(columns[f], t) if f in columns else pa.nulls(size, t) for f, t in _FIELDS]
    return pa.Table.from_batches(pa.table(given, schema=_SCHEMA).to_batches(AT_ONCE), _SCHEMA)


def _summed(block: Block, at: np.ndarray, words: int, name: int) -> pa.Table:
    """Distinct fingerprints of the n-grams at ``at`` with their counts and their first places."""
    distinct, first, n = np.unique(block.fingerprints(at, words), return_index=True, return_counts=True)
    same = lambda value: np.full(len(distinct), value)
    return _rows(len(distinct), words=same(words), n=n, fp=distinct, block=same(name), at=at[first])


def _words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("block").to_pylist()
        for i, name in enumerate(names):  # one body at a time, read where it lies
            block = Block(batch.column("grp")[i].as_py(), batch.column("body")[i].as_buffer())
            for words in (1, 2):
                yield from _summed(block, np.flatnonzero(block.places(words)), words, name).to_batches()
            pa.default_memory_pool().release_unused()


def _longer(block: Block, name: int, known: np.ndarray, words: int) -> pa.Table:
    """n-grams of a block both of whose parts of one word less are among ``known`` fingerprints."""
    shorter = np.flatnonzero(block.places(words - 1))
    marked = np.zeros(len(block.ends), bool)
    marked[shorter] = np.isin(block.fingerprints(shorter, words - 1), known)
    ok = block.places(words)
    ok &= marked
    ok[:-1] &= marked[1:]
    return _summed(block, np.flatnonzero(ok), words, name)


def _marked(longest: int, more: bool):
    """For a block and its marked fingerprints, of up to ``longest`` words: the phrases they stand
    for as texts and, if there are ``more`` to come, the fingerprints of n-grams of one word more."""

    def work(key: tuple, bodies: pa.Table, marks: pa.Table) -> pa.Table:
        if bodies.num_rows == 0 or marks.num_rows == 0:
            return _SCHEMA.empty_table()
        block = Block(bodies.column("grp")[0].as_py(), bodies.column("body")[0].as_buffer())
        lengths = marks.column("words").to_numpy()
        fps, pointers = marks.column("fp").to_numpy(), marks.column("at").to_numpy()
        parts = []
        for words in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == words)
            own = own[np.argsort(fps[own])]
            parts += _materialised(block, words, fps[own], pointers[own])
        if more:
            parts.append(_longer(block, key[0].as_py(), fps[lengths == longest], longest + 1))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(parts)

    return work


def _materialised(block: Block, words: int, fps: np.ndarray, pointers: np.ndarray) -> list[pa.Table]:
    """The phrases of the (sorted) fingerprints, their occurrences verified byte by byte."""
    at = np.flatnonzero(block.places(words))
    found = block.fingerprints(at, words)
    slot = np.minimum(np.searchsorted(fps, found), len(fps) - 1)
    hit = fps[slot] == found
    at, slot = at[hit], slot[hit]
    same = np.ones(len(at), bool)
    for first in range(0, len(at), AT_ONCE):
        some = slice(first, first + AT_ONCE)
        same[some] = _equal(block, at[some], pointers[slot[some]], words)
    counts = np.bincount(slot[same], minlength=len(fps))
    parts = []
    for first in range(0, len(fps), AT_ONCE):
        some = slice(first, first + AT_ONCE)
        parts.append(_texts(block, pointers[some], words, counts[some]))
    others: dict[bytes, int] = {}
    for place in at[~same].tolist():  # other phrases of the same fingerprint
        raw = block.raw[block.starts[place] : block.ends[place + words - 1]].tobytes()
        others[raw] = others.get(raw, 0) + 1
    for raw, n in others.items():
        parts.append(_rows(1, words=[words], n=[n], grp=[block.group], phrase=[raw.decode()]))
    return parts


def _equal(block: Block, a: np.ndarray, b: np.ndarray, words: int) -> np.ndarray:
    """Whether the phrases at ``a`` have the bytes of those at ``b``."""
    size = lambda at: block.ends[at + words - 1] - block.starts[at]
    same = size(a) == size(b)
    away = np.flatnonzero(same & (a != b))
    if len(away):
        left, lengths = block.bytes_of(a[away], words)
        right, _ = block.bytes_of(b[away], words)
        heads = np.cumsum(lengths) - lengths
        same[away] = ~np.logical_or.reduceat(left != right, heads)
    return same


def _texts(block: Block, at: np.ndarray, words: int, counts: np.ndarray) -> pa.Table:
    data, lengths = block.bytes_of(at, words)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    phrase = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    size = len(at)
    return _rows(size, words=np.full(size, words), n=counts, grp=pa.repeat(block.group, size), phrase=phrase)


def _frequent(found: DataFrame, least: int) -> DataFrame:
    """(block, words, fp, at) of every fingerprint that all blocks together hold ``least`` times."""
    occurrences = found.filter("fp IS NOT NULL").select("fp", "block", "words", "at", "n")
    total = F.sum("n").over(Window.partitionBy("fp"))
    marked = occurrences.withColumn("total", total).filter(F.col("total") >= least)
    return stage(marked.select("block", "words", "fp", "at"), "phrase-marks")


def frequencies(laid: DataFrame, max_words: int = 3, least: int = 10) -> DataFrame:
    """(grp, words, phrase, n): exact counts of all phrases of up to ``max_words`` (at least two) words
    that occur ``least`` times or more in their group. ``laid`` are the rows of :func:`blocks`."""
    bodies = laid.select("block", "grp", "body")
    with _shuffles_removed(laid.sparkSession):
        found = bodies.mapInArrow(_words_and_pairs, _ROWS)
        texts = []
        for words in range(2, max_words + 1):
            marks = _frequent(found, least)
            both = bodies.groupBy("block").cogroup(marks.groupBy("block"))
            found = both.applyInArrow(_marked(words, words < max_words), _ROWS)
            # the last length has nothing after it that would read it again
            found = stage(found, "phrase-found") if words < max_words else found
            texts.append(found.filter("phrase IS NOT NULL").select("grp", "words", "phrase", "n"))
        every = functools.reduce(DataFrame.unionByName, texts)
        counted = every.groupBy("grp", "words", "phrase").agg(F.sum("n").alias("n"))
        return stage(counted.filter(F.col("n") >= least), "phrase-counts")


def _part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(counts: DataFrame, cover_percent: int = 50) -> DataFrame:
    """(grp, phrase, words, a, l, r, score) of the phrases of two words or more in ``counts`` that no
    longer one covers: one that contains it and is at least ``cover_percent`` as frequent."""
    listed = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    inner = listed.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    covers = (
        inner.select("grp", _part(F.col("w"), F.col("from"), F.col("size")).alias("phrase"), "n")
        .groupBy("grp", "phrase")
        .agg(F.max("n").alias("longer"))
    )
    covered = F.coalesce(100 * F.col("longer") >= cover_percent * F.col("n"), F.lit(False))
    free = listed.join(covers, ["grp", "phrase"], "left").filter(~covered)
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "grp",
        "words",
        F.col("n").alias("a"),
        "k",
        _part(F.col("w"), F.lit(1), F.col("k")).alias("left"),
        _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    of = lambda name, count: counts.select("grp", F.col("phrase").alias(name), F.col("n").alias(count))
    weighed = cuts.join(of("left", "l"), ["grp", "left"]).join(of("right", "r"), ["grp", "right"])
    exact = lambda name: F.col(name).cast("decimal(15,0)")
    above = (exact("a") * exact("a")).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    weighed = weighed.withColumns(
        {"above": above.cast("decimal(38,0)"), "below": (exact("l") * exact("r")).cast("decimal(38,0)")}
    ).withColumn("score", F.expr("above div below"))
    phrase = F.concat_ws(" ", "left", "right").alias("phrase")
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (
        weighed.groupBy("grp", phrase, "words", "a")
        .agg(lowest)
        .select("grp", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
    )


def first_of_groups(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of every group with their ``rank``: falling score, falling count, phrase.

    Parts of a group are cut to their first k on their own before these meet.
    """
    rows = stage(rows, "phrase-scores")
    parts = 1 + rows.count() // TOP_ROWS
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))
    some = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("place", place)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("bigint")
    return some.filter(F.col("place") <= k).drop("part", "place").withColumn("rank", rank).filter(F.col("rank") <= k)


def collocations(
    docs: DataFrame,
    text: str = "text",
    group: str = "lang",
    max_words: int = 3,
    least: int = 10,
    k: int = 2000,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(grp, rank, phrase, words, a, l, r, n, score): the first ``k`` phrases of every group; n are
    the words of the group."""
    laid = blocks(docs, text, group, block_bytes)
    best = first_of_groups(scored(frequencies(laid, max_words, least)), k)
    totals = laid.groupBy("grp").agg(F.sum("words").alias("n"))
    return best.join(totals, "grp")

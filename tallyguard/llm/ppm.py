"""Language-model scores by prediction by partial matching, next to a unigram base score.

The model is pretrained on the corpus: the trie of byte contexts up to ``order`` bytes is a
table of grams (context and next byte) with their counts in the training documents. A byte is
predicted from its longest context; where that has not seen the byte, the escape probability
of method C is paid and the next shorter context predicts among the bytes not yet excluded.
Below order zero the bytes that are left are equally likely. So the probability of a byte
depends on its gram alone: it is found once per distinct gram and read back by position.

Grams and words go through the blocks and shards of ``blocks``: a block lists its distinct
grams and words with their training counts, shards add the counts up, and every block gets a
value for each entry of its lists. Counts cover all training documents, scores all documents.

Texts are whole and lower-cased in A-Z; a null text is empty. Every text ends with an end
symbol. Ids may repeat or be null (a null id is trained on as the text "" would be hashed);
each row gives one row. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from .blocks import (
    SHARD_BYTES,
    block_name,
    dealt,
    numbers,
    pack,
    pack_words,
    shard_count,
    unpack,
    unpack_words,
)
from .phrases import _shuffles_removed

ORDER = 5
BLOCK_BYTES = 8 << 20
SYMBOLS, EDGE, BITS = 257, 256, 9  # bytes, and one symbol for both ends of a text
_DENSE = 1 << 26  # largest table of pairs; beyond it pairs are sorted

_BLOCK = (
    "block bigint, ids array<bigint>, held array<boolean>, lengths array<int>, text binary, "
    "kind string, shard int, listed binary"
)
_ANSWER = "block bigint, kind string, answer binary"
_COUNTED = "block bigint, kind string, answer binary, tokens bigint, types bigint"
_SCORED = (
    "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
)


def held_out(id_col: Column) -> Column:
    """Documents that the model does not learn from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(7)) == 2


def _paired(
    ids: np.ndarray, size: int, nxt: np.ndarray, base: int
) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct pairs (ids, nxt < base): the numbers, and the pair behind each."""
    span = size * base
    key = ids.astype(np.int32 if span < 1 << 31 else np.int64) * base + nxt
    if span > _DENSE:
        pairs, number = np.unique(key, return_inverse=True)
        return number.astype(np.int32), pairs.astype(np.int64)
    there = np.zeros(span, np.bool_)
    there[key] = True
    pairs = np.flatnonzero(there)
    number = np.empty(span, np.int32)
    number[pairs] = np.arange(len(pairs), dtype=np.int32)
    return number[key], pairs


def grams_of(joined: bytes, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, codes, ends): the gram of every symbol of the texts, by distinct code.

    A code holds the symbol in its lowest bits and the context above, the nearest byte lowest.
    ``ends`` are the positions after each text's end symbol.
    """
    ends = np.cumsum(lengths + 1)
    symbol = np.full(int(ends[-1]) if len(ends) else 0, EDGE, np.uint16)
    inner = np.ones(len(symbol), np.bool_)
    inner[ends - 1] = False
    symbol[inner] = np.frombuffer(joined, np.uint8)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    # the symbols that occur, numbered densely, keep the tables of pairs small
    alphabet = np.union1d(np.flatnonzero(np.bincount(symbol, minlength=SYMBOLS)), [EDGE])
    dense = np.zeros(SYMBOLS, np.uint16)
    dense[alphabet] = np.arange(len(alphabet))
    symbol, edge, base = dense[symbol], dense[EDGE], len(alphabet)
    number, pairs = _paired(np.zeros(len(symbol), np.int32), 1, symbol, base)
    codes = alphabet[pairs]
    for back in range(1, order + 1):
        context = np.full(len(symbol), edge, np.uint16)
        context[back:] = symbol[:-back] if len(symbol) > back else context[back:]
        for shift in range(back):  # contexts do not reach into the text before
            at = starts + shift
            context[at[at < ends]] = edge
        number, pairs = _paired(number, len(codes), context, base)
        codes = codes[pairs // base] | (alphabet[pairs % base] << BITS * back)
    return number, codes, ends


def words_of(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers, words, ends): every word of the texts by distinct word."""
    index: dict[bytes, int] = {}
    parts = [
        np.array([index.setdefault(w, len(index)) for w in text.split()], np.int32) for text in texts
    ]
    ends = np.cumsum([len(p) for p in parts]) if parts else np.array([], np.int64)
    return np.concatenate(parts) if parts else ends.astype(np.int32), list(index), ends


def _gram_shard(codes: np.ndarray, shards: int) -> np.ndarray:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _halves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (codes >> 32).astype(np.uint32), (codes & 0xFFFFFFFF).astype(np.uint32)


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low.astype(np.int64)


def _list_blocks(shards: int, order: int, block_bytes: int):
    def close(name: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = b"".join(texts)
        rows = [(name, ids, held, lengths.tolist(), pack(joined), "text", None, None)]
        learnt = ~np.array(held, np.bool_)

        def counted(number: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
            sizes = np.diff(ends, prepend=0)
            return np.bincount(number[np.repeat(learnt, sizes)], minlength=size)

        number, words, ends = words_of(texts)
        n = counted(number, ends, len(words))
        for shard, own in dealt(words, shards):
            gaps = np.diff(own, prepend=0)
            listed = pack_words([words[i] for i in own], gaps, n[own])
            rows.append((name, None, None, None, None, "word", shard, listed))
        number, codes, ends = grams_of(joined, lengths, order)
        n = counted(number, ends, len(codes))
        shard_of = _gram_shard(codes, shards)
        by_shard = np.argsort(shard_of, kind="stable")
        for own in np.split(by_shard, np.flatnonzero(np.diff(shard_of[by_shard])) + 1):
            if len(own):
                listed = pack(np.diff(own, prepend=0), *_halves(codes[own]), n[own])
                rows.append((name, None, None, None, None, "gram", int(shard_of[own[0]]), listed))
        kinds = (
            pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()),
            pa.binary(), pa.string(), pa.int32(), pa.binary(),
        )
        names = ["block", "ids", "held", "lengths", "text", "kind", "shard", "listed"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list = []
        texts: list[bytes] = []
        size = seen = 0
        for batch in batches:
            columns = (batch.column("id"), batch.column("held"), batch.column("text").cast(pa.binary()))
            for doc, out, text in zip(*columns):
                ids.append(doc.as_py())
                held.append(out.as_py())
                texts.append((text.as_py() or b"").lower())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield close(block_name(seen), ids, held, texts)
                    ids, held, texts, size, seen = [], [], [], 0, seen + 1
        if ids:
            yield close(block_name(seen), ids, held, texts)

    return work


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers with the training count of every word; one more row holds N and V of the shard."""
    counts: dict[bytes, int] = {}
    kept: list[tuple[int, bytes]] = []  # compressed, as they came
    for batch in batches:
        for block, listed in zip(batch.column("block"), batch.column("listed")):
            kept.append((block.as_py(), listed.as_py()))
            words, (_, n) = unpack_words(kept[-1][1])
            for word, more in zip(words, n.tolist()):
                counts[word] = counts.get(word, 0) + more

    def row(block: int | None, kind: str, payload: bytes | None, tokens: int, types: int) -> pa.RecordBatch:
        values = (block, kind, payload, tokens, types)
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array([v], k) for v, k in zip(values, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["block", "kind", "answer", "tokens", "types"])

    for block, listed in kept:
        words, (gaps, _) = unpack_words(listed)
        found = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
        yield row(block, "word", pack(gaps, found.tobytes()), 0, 0)
    yield row(None, "total", None, sum(counts.values()), sum(1 for c in counts.values() if c))


def _add_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of a shard with their training counts."""
    codes, counts = np.array([], np.int64), np.array([], np.int64)
    for batch in batches:
        for listed in batch.column("listed"):
            _, high, low, n = map(numbers, unpack(listed.as_py()))
            merged = np.concatenate([codes, _whole(high, low)])
            codes, place = np.unique(merged, return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n.astype(np.int64)]), len(codes))
    for start in range(0, len(codes), 100_000):
        part = slice(start, start + 100_000)
        n = counts[part].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes[part]), pa.array(n)], names=["gram", "n"])


def _answer_grams(key: tuple, listed: pa.Table, scored: pa.Table) -> pa.Table:
    codes, score = scored.column("gram").to_numpy(), scored.column("logp").to_numpy()
    order = np.argsort(codes)
    codes, score = codes[order], score[order]
    answers = []
    for row in listed.column("listed"):
        gaps, high, low, _ = map(numbers, unpack(row.as_py()))
        answers.append(pack(gaps, score[np.searchsorted(codes, _whole(high, low))].tobytes()))
    kind = pa.array(["gram"] * len(answers), pa.string())
    return pa.table({"block": listed.column("block"), "kind": kind, "answer": pa.array(answers, pa.binary())})


def gram_scores(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp): log10 probability of each gram's symbol after its context.

    ``grams(gram, n)`` holds every gram that is to be scored once, with its training count.
    """
    suffix = lambda c, j: c.bitwiseAND(F.lit((1 << BITS * (j + 1)) - 1))
    above = lambda c: F.shiftright(c, BITS)
    seen = grams.filter("n > 0").select(F.col("gram").alias("key"), "n")
    counts = {order: seen}
    for j in range(order - 1, -1, -1):
        shorter = counts[j + 1].groupBy(suffix(F.col("key"), j).alias("key")).agg(F.sum("n").alias("n"))
        counts[j] = stage(shorter, f"ppm-counts-{j}")

    def contexts(j: int) -> DataFrame:
        """N, d of each context, and what it excludes from the next shorter one (zero at order 0)."""
        rows = counts[j].select("key", "n")
        if j:
            lower = counts[j - 1].select(F.col("key").alias("low"), F.col("n").alias("n_low"))
            rows = rows.join(lower, suffix(F.col("key"), j - 1) == F.col("low"))
        gone = F.sum("n_low") if j else F.lit(0)
        return rows.groupBy(above(F.col("key")).alias("ctx")).agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"), gone.alias("gone")
        )

    scored = grams.select("gram").withColumns(
        {"logp": F.lit(0.0), "open": F.lit(True), "x_n": F.lit(0), "x_d": F.lit(0)}
    )
    for j in range(order, -1, -1):
        key = suffix(F.col("gram"), j)
        own = counts[j].select(F.col("key").alias("_key"), F.col("n").alias("_n"))
        scored = (
            scored.withColumns({"_at": key, "_ctx": above(key)})
            .join(own, F.col("_at") == F.col("_key"), "left")
            .join(contexts(j), F.col("_ctx") == F.col("ctx"), "left")
        )
        total = F.coalesce("total", F.lit(0)) - F.col("x_n")
        distinct = F.coalesce("distinct", F.lit(0)) - F.col("x_d")
        hit = F.col("_n").isNotNull()
        step = (
            F.when(hit, F.log10(F.col("_n") / (total + distinct)))
            .when(distinct > 0, F.log10(distinct / (total + distinct)))
            .otherwise(F.lit(0.0))
        )
        scored = scored.select(
            "gram",
            F.when(F.col("open"), F.col("logp") + step).otherwise(F.col("logp")).alias("logp"),
            (F.col("open") & ~hit).alias("open"),
            F.coalesce("gone", F.lit(0)).alias("x_n"),
            F.coalesce("distinct", F.lit(0)).alias("x_d"),
        )
    left = F.lit(SYMBOLS) - F.col("x_d")  # symbols that no document has
    uniform = F.when(F.col("open"), -F.log10(left)).otherwise(F.lit(0.0))
    return scored.select("gram", (F.col("logp") + uniform).alias("logp"))


def _score_block(n_all: int, n_distinct: int, n_docs: int, order: int):
    def values(answers: pa.Table, kind: str, dtype: type, size: int) -> np.ndarray:
        out = np.zeros(size, dtype)
        for name, answer in zip(answers.column("kind"), answers.column("answer")):
            if name.as_py() == kind:
                gaps, found = unpack(answer.as_py())
                out[np.cumsum(numbers(gaps), dtype=np.int64)] = np.frombuffer(found, dtype)
        return out

    def per_text(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        return np.bincount(owner, value, len(ends))

    def unigram(count: np.ndarray | int) -> np.ndarray:
        return np.log10((np.asarray(count) + 1) / (n_all + n_distinct + 1))

    def work(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (joined,) = unpack(blocks.column("text")[0].as_py())
        lengths = np.array(blocks.column("lengths")[0].as_py(), np.int64)
        cuts = np.cumsum(lengths).tolist()
        texts = [joined[s:e] for s, e in zip([0, *cuts], cuts)]
        number, words, ends = words_of(texts)
        count = values(answers, "word", np.int64, len(words))
        base = per_text(unigram(count)[number], ends) + unigram(n_docs)
        known = per_text((count > 0)[number], ends).astype(np.int64) + (n_docs > 0)
        n_tokens = np.diff(ends, prepend=0) + 1
        number, codes, ends = grams_of(joined, lengths, order)
        score = per_text(values(answers, "gram", np.float64, len(codes))[number], ends)
        return pa.table(
            {
                "id": blocks.column("ids")[0].values,
                "held_out": blocks.column("held")[0].values,
                "n_tokens": n_tokens,
                "n_known": known,
                "base_score": base,
                "score": score,
            }
        )

    return work


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text).alias("text"),
        held_out(F.col(id_col)).alias("held"),
    )
    shards = shard_count(rows, "text", shard_bytes)
    made = stage(rows.mapInArrow(_list_blocks(shards, order, block_bytes), _BLOCK), "ppm-blocks")
    # later jobs continue from files, so the shuffle files of each go when it is over
    with _shuffles_removed(docs.sparkSession):
        return _scored(made, shards, order)


def _scored(made: DataFrame, shards: int, order: int) -> DataFrame:
    listed = {k: made.filter(F.col("kind") == k).select("block", "shard", "listed") for k in ("word", "gram")}

    counted = listed["word"].groupBy("shard").applyInArrow(_count_words, _COUNTED)
    words = stage(counted, "ppm-words")
    sums = words.agg(F.sum("tokens"), F.sum("types")).first()
    learnt = F.size(F.filter("held", lambda h: ~h))
    n_docs = made.filter("kind = 'text'").agg(F.sum(learnt)).first()[0] or 0
    n_all, n_distinct = (sums[0] or 0) + n_docs, (sums[1] or 0) + (n_docs > 0)

    grams = listed["gram"].groupBy("shard").applyInArrow(_add_grams, "gram bigint, n bigint")
    grams = stage(grams, "ppm-grams")
    scored = stage(gram_scores(grams, order), "ppm-scores")
    sharded = scored.mapInArrow(_with_shard(shards), "gram bigint, logp double, shard int")
    found = listed["gram"].groupBy("shard").cogroup(sharded.groupBy("shard"))
    counts = words.filter("kind = 'word'").select("block", "kind", "answer")
    answers = counts.unionByName(found.applyInArrow(_answer_grams, _ANSWER))

    blocks = made.filter("kind = 'text'").select("block", "ids", "held", "lengths", "text")
    work = _score_block(n_all, n_distinct, n_docs, order)
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, _SCORED)
    return out.withColumn("train_tokens", F.lit(n_all).cast("bigint"))


def _with_shard(shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _gram_shard(batch.column("gram").to_numpy(), shards).astype(np.int32)
            yield batch.append_column("shard", pa.array(shard))

    return work

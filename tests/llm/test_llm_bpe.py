import sys

import pytest
from tokenizers import Tokenizer

from tallyguard.llm import bpe
from tallyguard.llm.queries import tokenizer_json

HARD = [
    "I'll can't they're we've I'm he'd it's 'S 'LL ''s",
    "a  b   c\n\n d \t e   ",
    "   ",
    "\n\n\nx\r\n\r\ny\u00a0\u00a0z\u3000w\u2028v",
    "<|endoftext|>",
    "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endof",
    "naïve Ünïcödé \U0001f600\U0001f468\u200d\U0001f469 日本語 ١٢٣ ½ Ⅷ x² \x00\x01",
    "0123456789 1,234.56 a1b2",
    "letters of later versions \u0558\U000191a0a \u0558 b\u058c1\U0001e5f1 '\u0558s",
    "é" * 3000,
    "ab" * 20000,
]


@pytest.fixture(scope="module")
def json_text():
    return tokenizer_json()


@pytest.fixture(scope="module")
def library(json_text):
    tokenizer = Tokenizer.from_str(json_text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check(rows, library):
    for row in rows:
        text = row["text"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row["ids"] == ids
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)


def roundtrip(docs, json_text, **sizes):
    numbered = docs.selectExpr("text", "monotonically_increasing_id() AS doc_id")
    coded = bpe.encode(numbered, json_text, **sizes)
    both = bpe.decode(coded, json_text, out="decoded")
    texts = {r["doc_id"]: r["text"] for r in numbered.collect()}
    rows = [{**r.asDict(), "text": texts[r["id"]]} for r in both.collect()]
    assert len(rows) == len(texts)
    return rows


@pytest.mark.parametrize("block, shard", [(1 << 24, 48 << 20), (200, 500)])
def test_against_the_library(odd, spark, json_text, library, block, shard):
    docs = odd.select("text").union(spark.createDataFrame([(t,) for t in HARD], "text string"))
    docs = spark.createDataFrame(docs.collect(), docs.schema).coalesce(2)
    check(roundtrip(docs, json_text, block_bytes=block, shard_bytes=shard), library)


def test_words_of_every_code_point(json_text, library):
    """The splitting pattern agrees with the library on every character, between two others."""
    split = bpe.splitter([], bpe.newer_characters(json_text))
    pre = library.pre_tokenizer
    shown = {b: c for c, b in _byte_names().items()}
    points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    for start in range(0, len(points), 4096):
        text = "".join(f"a{chr(p)}1 {chr(p)}{chr(p)}.\n" for p in points[start : start + 4096])
        want = [name for name, _ in pre.pre_tokenize_str(text)]
        got = ["".join(shown[b] for b in word.encode()) for word in split(text)]
        assert got == want


def _byte_names():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in shown]
    return names | {chr(256 + i): b for i, b in enumerate(hidden)}


def test_decode_any_ids(spark, json_text, library):
    lists = [[], [50256, 0, 255], [220, 220, 198], list(range(0, 50257, 13)), [188, 200, 190]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(9, None)], "id bigint, ids array<int>")
    for row in bpe.decode(rows, json_text).collect():
        assert row["text"] == library.decode(row["ids"] or [], skip_special_tokens=False)


def test_nulls_repeats_and_empty(odd, empty, json_text):
    ids = sorted(str(r["id"]) for r in bpe.encode(odd, json_text).collect())
    assert ids == sorted(str(r["doc_id"]) for r in odd.collect())
    assert bpe.encode(empty, json_text).count() == 0


def test_other_tokenizers_are_refused(odd, json_text):
    with pytest.raises(ValueError):
        bpe.encode(odd, json_text.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyguard.llm import token_counts
from tallyguard.llm.queries import QUERIES, tokenizer_json

HARD = [
    "I'll can't they're we've I'm he'd it's 'S 'LL ''s " * 40,
    "a  b   c\n\n d \t e   " * 60,
    " " * 700 + "x" + " " * 301,
    "\n" * 500 + " \n" * 300 + "end",
    "<|endoftext|>" * 90,
    "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endof text|> <|" * 30,
    "a" * 2000,
    "word " * 60 + "b" * 900 + " word" * 60 + "?" * 400 + "'re" * 300,
    "naïve Ünïcödé \U0001f600\U0001f468‍\U0001f469 日本語 ١٢٣ ½ Ⅷ x² \x00\x01" * 40,
    "letters of later versions ՘\U000191a0a ՘ b֌1\U0001e5f1 '՘s" * 30,
    "0123456789 1,234.56 a1b2\r\n" * 50,
    "l'été d'où qu'elle 'll 're 've" * 30,
]


@pytest.fixture(scope="module")
def json_text():
    return tokenizer_json()


@pytest.fixture(scope="module")
def library(json_text):
    tokenizer = Tokenizer.from_str(json_text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def against(docs, library, json_text, **sizes):
    rows = docs.select("text").withColumn("doc_id", F.monotonically_increasing_id())
    rows = docs.sparkSession.createDataFrame(rows.collect(), rows.schema)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    found = token_counts.count(rows, json_text, **sizes).collect()
    assert len(found) == len(texts)
    for row in found:
        text = texts[row["id"]]
        assert row["n_bytes"] == len((text or "").encode())
        assert row["n_tokens"] == library(text), (row["id"], text)


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 256), (61, 20), (90, 9), (200, 40)])
def test_against_the_library(odd, spark, json_text, library, chunk, overlap):
    """Chunks of some dozen characters cut words, contractions, blanks and special tokens."""
    rng = random.Random(chunk)
    odds = " \n'sretaé1?<|endoftext|>"
    mixed = ["".join(rng.choice(["word", " ", "'re", "<|endoftext|>", *odds]) for _ in range(700)) for _ in range(12)]
    hard = spark.createDataFrame([(t,) for t in HARD + mixed], "text string")
    against(odd.select("text").union(hard), library, json_text, chunk=chunk, overlap=overlap)


def test_a_pre_token_longer_than_many_chunks(spark, json_text, library):
    """All junctions inside it fail; the overlaps are widened until they cover it."""
    texts = ["x " * 200 + "z" * 5000 + " y" * 200, "q" * 4000, "é" * 3000 + "." * 3000]
    against(spark.createDataFrame([(t,) for t in texts], "text string"), library, json_text, chunk=100, overlap=20)


def test_one_text_holds_most_of_the_table(spark, json_text, library):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("retaion", k=rng.randrange(1, 9))) for _ in range(60_000))
    rows = [(text,), ("short",), (text,)]
    against(spark.createDataFrame(rows, "text string"), library, json_text)


def test_ids_of_any_type_and_empty(odd, empty, spark, json_text):
    assert token_counts.count(empty, json_text).count() == 0
    rows = spark.createDataFrame([("a", "x y"), (None, None), ("a", "x y")], "doc_id string, text string")
    found = sorted(map(tuple, token_counts.count(rows, json_text).collect()), key=str)
    assert found == [("a", 3, 2), ("a", 3, 2), (None, 0, 0)]
    assert token_counts.count(odd, json_text).count() == odd.count()


def test_sizes_that_cannot_align_are_refused(odd, json_text):
    with pytest.raises(ValueError):
        token_counts.count(odd, json_text, chunk=100, overlap=8)
    with pytest.raises(ValueError):
        token_counts.count(odd, json_text, chunk=60, overlap=25)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op11_token_counts"](spark, sf).collect()
    assert len(found) == len(want)
    for row in found:
        n = library(want[row["doc_id"]])
        assert (row["n_tokens"], row["over_limit"]) == (n, n > 1024)

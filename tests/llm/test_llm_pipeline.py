import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tallyguard.llm import mixing
from tallyguard.llm.queries import tokenizer_json

from .test_llm_mixing import brute_targets
from .test_llm_quality import brute as brute_quality
from .test_llm_secrets import brute as brute_secrets
from .test_llm_simhash import brute_fingerprint, brute_roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    odd.select(*columns).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def staged(spark, folder):
    """The rows after every stage, each stage fed with the rows before it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for _, step in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(step(spark, docs, folder).collect(), step(spark, docs, folder).schema)
        out.append(docs.collect())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_dedup", "secret_scan", "source_mix", "bpe_encode"
    ]


def test_quality_stage(staged):
    before, after = staged[0], staged[1]
    assert not any(brute_quality(r["text"])["base_failed"] for r in after)
    assert not Counter(after) - Counter(before)


def test_dedup_stage(staged):
    before, after = staged[1], staged[2]
    assert not Counter(after) - Counter(before)
    prints = sorted({brute_fingerprint(r["text"]) for r in before})
    root = dict(zip(prints, brute_roots(prints, 4)))
    groups = Counter(root[brute_fingerprint(r["text"])] for r in after)
    assert set(groups.values()) == {1} and set(groups) == set(root.values())


def test_secrets_stage(staged):
    assert len(staged[2]) == len(staged[3])
    assert all(brute_secrets(r["text"]) == [] for r in staged[3])


def test_mix_stage(staged):
    before, after = staged[3], staged[4]
    sizes = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    targets = brute_targets({s: sizes[s] for s in names}, mixing.WEIGHTS, mixing.EPOCHS)
    words = Counter()
    for r in after:
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(words[s] - t) <= 1 for s, t in targets.items())


def test_encode_stage(staged):
    before, after = staged[4], staged[5]
    tokenizer = Tokenizer.from_str(tokenizer_json())
    want = Counter(
        (r["doc_id"], tuple(tokenizer.encode(r["text"], add_special_tokens=False).ids)) for r in before
    )
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == want


def test_run_is_the_stages_in_order(spark, folder, staged):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter(
        (r["doc_id"], tuple(r["ids"])) for r in staged[5]
    )


def test_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names

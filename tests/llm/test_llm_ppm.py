import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyguard.llm import ppm


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def brute_base(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for _, t in rows]
    counts = Counter(w for (d, _), ws in zip(rows, tokens) if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    score = [sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) for ws in tokens]
    known = [sum(counts[w] > 0 for w in ws) for ws in tokens]
    return n, [len(ws) for ws in tokens], known, score


def brute_ppm(rows, order):
    """Byte by byte over a dictionary of contexts, symbols excluded one by one."""
    contexts = defaultdict(Counter)

    def symbols(text):
        return [256] * order + list(lower(text).encode()) + [256]

    for doc, text in rows:
        if not held(doc):
            seq = symbols(text)
            for i in range(order, len(seq)):
                for j in range(order + 1):
                    contexts[tuple(seq[i - j : i])][seq[i]] += 1
    out = []
    for _, text in rows:
        seq, score = symbols(text), 0.0
        for i in range(order, len(seq)):
            excluded = set()
            for j in range(order, -1, -1):
                seen = contexts.get(tuple(seq[i - j : i]), {})
                open_counts = {s: n for s, n in seen.items() if s not in excluded}
                total, distinct = sum(open_counts.values()), len(open_counts)
                if seq[i] in open_counts:
                    score += math.log10(open_counts[seq[i]] / (total + distinct))
                    break
                if distinct:
                    score += math.log10(distinct / (total + distinct))
                excluded |= set(seen)
            else:
                score -= math.log10(257 - len(excluded))
        out.append(score)
    return out


@pytest.mark.parametrize("order, block, shard", [(4, 8 << 20, 48 << 20), (2, 300, 700), (0, 5000, 1000)])
def test_scores_against_brute_force(spark, odd_python, order, block, shard):
    rows = [(i, r[1]) for i, r in enumerate(odd_python)]
    rows = [(i, t if len(t or "") < 3000 else t[:3000]) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    got = {r["id"]: r for r in ppm.score(docs, order=order, block_bytes=block, shard_bytes=shard).collect()}
    n, sizes, known, base = brute_base(rows)
    for (doc, _), size, k, b, s in zip(rows, sizes, known, base, brute_ppm(rows, order)):
        r = got[doc]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(doc), size, k, n)
        assert r["base_score"] == pytest.approx(b, rel=1e-9)
        assert r["score"] == pytest.approx(s, rel=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["abracadabra", "alakazam", "abba", "baobab"])]
    contexts = ["", "a", "ab", "zz", "bra"]
    queries = []
    for context in contexts:
        past = ([256] * 3 + list(context.encode()))[-3:]
        for symbol in range(257):
            queries.append(symbol | past[2] << 9 | past[1] << 18 | past[0] << 27)
    seen = Counter()
    for _, text in rows:
        _, codes, _ = ppm.grams_of(text.encode(), np.array([len(text)]), 3)
        number, codes, _ = ppm.grams_of(text.encode(), np.array([len(text)]), 3)
        seen.update(codes[number].tolist())
    asked = set(queries) | set(seen)
    grams = spark.createDataFrame([(g, seen[g]) for g in asked], "gram bigint, n bigint")
    logp = {r["gram"]: r["logp"] for r in ppm.gram_scores(grams, 3).collect()}
    for i in range(len(contexts)):
        part = queries[257 * i : 257 * (i + 1)]
        assert sum(10 ** logp[g] for g in part) == pytest.approx(1.0)


def test_longer_contexts_predict_held_out_text_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = "sum(score) / sum(octet_length(text) + 1)"
    joined = {
        order: ppm.score(docs, order=order)
        .filter("held_out")
        .join(docs.selectExpr("doc_id AS id", "text"), "id")
        .selectExpr(total)
        .first()[0]
        for order in (0, 2, 4)
    }
    assert math.log10(1 / 257) < joined[0] < joined[2] < joined[4] < 0


def test_model_beats_its_base_on_text_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sums = ppm.score(docs).groupBy("held_out").sum("score", "base_score").collect()
    assert len(sums) == 2
    for row in sums:
        assert row["sum(score)"] > row["sum(base_score)"]


def test_dense_and_sorted_pairs_agree(monkeypatch):
    text = b"some text of some length" * 20
    dense = ppm.grams_of(text, np.array([200, 0, 280]), 3)
    monkeypatch.setattr(ppm, "_DENSE", 0)
    plain = ppm.grams_of(text, np.array([200, 0, 280]), 3)
    assert np.array_equal(dense[1][dense[0]], plain[1][plain[0]])


def test_nulls_and_empty_table(odd, empty):
    got = ppm.score(odd)
    assert got.count() == odd.count()
    assert got.filter("score IS NULL OR base_score IS NULL OR score > 0").count() == 0
    assert ppm.score(empty).count() == 0

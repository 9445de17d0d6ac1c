import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyguard.llm import phrases
from tallyguard.llm.queries import QUERIES

WORDS = "the of to ra ne ti on er sh and lo mi été ß  x 12 a-b".split(" ")


def worded(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)) if w]


def brute(rows, max_words=3, least=10, k=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in worded(text):
            totals[lang] += len(piece)
            for n in range(1, max_words + 1):
                counts.update((lang, tuple(piece[i : i + n])) for i in range(len(piece) - n + 1))
    kept = {x: f for x, f in counts.items() if f >= least and len(x[1]) > 1}
    found = {}
    for (lang, w), a in kept.items():
        longer = (
            f
            for (other, v), f in kept.items()
            if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))
        )
        if any(100 * f >= 50 * a for f in longer):
            continue
        cuts = [(counts[lang, w[:i]], counts[lang, w[i:]]) for i in range(1, len(w))]
        score, _, left, right = min((10**6 * a * a // (x * y), i, x, y) for i, (x, y) in enumerate(cuts))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, some in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(some)[:k], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(n=400, seed=3):
    rng = random.Random(seed)
    seps = [" "] * 12 + ["  ", "\t", ". ", ",", ";\n", "\r\n", "\x0b", " ? ", "!", ":", "\x0c", " \t "]
    rows = []
    for i in range(n):
        words = [rng.choices(WORDS, weights=range(len(WORDS), 0, -1))[0] for _ in range(rng.randrange(0, 60))]
        words = [w.title() if rng.random() < 0.1 else w for w in words]
        text = "".join(w + rng.choice(seps) for w in words)
        rows.append((rng.choice([None, "en", "de", "en", ""]), text))
    return rows + [(None, None), ("fr", ""), ("fr", " .,\t"), ("xx", "one two " * 30), ("xx", "z" * 3000)]


def found(docs, **how):
    columns = ("grp", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in columns) for r in phrases.collocations(docs, **how).collect())


@pytest.mark.parametrize("size", [8 << 20, 700])
def test_against_brute_force(spark, size):
    """Also in many small blocks."""
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, words int, grp string")
    assert found(docs.repartition(3), block_bytes=size) == brute(rows)


def test_longer_phrases_and_other_limits(spark):
    rows = texts(150, seed=8)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs, max_words=4, least=5, k=40) == brute(rows, 4, 5, 40)


def test_copies_hold_most_rows(spark):
    rows = texts(60, seed=5) + [("en", "the quick pair of the quick pair. the quick pair")] * 3000
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert found(docs) == brute(rows)


def test_colliding_fingerprints(monkeypatch):
    """With fingerprints of two bits every block must tell phrases apart by their text."""
    import pyarrow as pa

    raw = "\n".join(t for _, t in texts(40) if t).encode()
    body = phrases.normalised(raw)
    monkeypatch.setattr(phrases, "_mixed", lambda values, salt: (values & np.uint64(3)).view(np.int64))
    block = phrases.Block("en", body)
    for n in (1, 2, 3):
        at = np.flatnonzero(block.places(n))
        marks = phrases._summed(block, at, n, 0)
        bodies = pa.table({"grp": ["en"], "body": pa.array([body], pa.binary())})
        rows = phrases._marked(n, False)((pa.scalar(0),), bodies, marks).to_pylist()
        want = Counter()
        for piece in worded(raw.decode()):
            want.update(" ".join(piece[i : i + n]) for i in range(len(piece) - n + 1))
        got = Counter()
        for row in rows:
            got[row["phrase"]] += row["n"]
        assert +got == want


def test_fingerprints_do_not_depend_on_place(monkeypatch):
    body = phrases.normalised(b"a b c d. " * 200 + b"q" * 500 + b" a b c")
    block = phrases.Block("x", body)
    at = np.flatnonzero(block.places(3))
    whole = block.fingerprints(at, 3)
    monkeypatch.setattr(phrases, "SEGMENT", 11)
    assert (block.fingerprints(at, 3) == whole).all()
    texts_of = [bytes(block.raw[block.starts[i] : block.ends[i + 2]]) for i in at]
    assert len(set(zip(texts_of, whole.tolist()))) == len(set(texts_of)) == len(set(whole.tolist()))
    assert (phrases.Block("y", body).fingerprints(at, 3) != whole).all()


def test_odd_and_empty(odd, empty, odd_python):
    rows = [(r[2], r[1]) for r in odd_python]
    assert found(odd) == brute(rows)
    assert found(empty) == []


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    a, left, right = 3 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 3
    rows = [("e", 1, "x", left), ("e", 1, "y", right), ("e", 2, "x y", a)]
    counts = spark.createDataFrame(rows, "grp string, words int, phrase string, n bigint")
    (row,) = phrases.scored(counts).collect()
    assert row["score"] == 10**6 * a * a // (left * right)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_phrases"](spark, sf).collect())
    assert got == brute(rows)

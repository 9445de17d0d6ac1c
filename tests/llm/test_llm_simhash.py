import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tallyguard.llm import simhash
from tallyguard.llm.components import components


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, radius):
    """Smallest index reachable among integers linked at ``radius`` bits or fewer."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        flipped = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(mask & flipped == 0 for mask in masks)


def test_groups_against_brute_force(odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    texts = odd.select("doc_id", "text").collect()
    want_fp = sorted((r["doc_id"] is None, r["doc_id"] or 0, brute_fingerprint(r["text"])) for r in texts)
    got_fp = sorted((r["id"] is None, r["id"] or 0, r["fp"] % (1 << 64)) for r in rows)
    assert got_fp == want_fp
    distinct = sorted({f for _, _, f in got_fp})
    root = dict(zip(distinct, brute_roots(distinct, 4)))
    low = {}
    for missing, doc, fp in got_fp:
        if not missing:
            low[root[fp]] = min(low.get(root[fp], doc), doc)
    assert all(r["component"] == low.get(root[r["fp"] % (1 << 64)]) for r in rows)


@pytest.mark.parametrize("joined, tile", [(16, 2048), (1, 3), (1, 10)])
def test_links_in_crowded_buckets(spark, monkeypatch, joined, tile):
    """Near copies around two centres, so that buckets hold many nodes and several components."""
    monkeypatch.setattr(simhash, "JOINED", joined)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(8)
    values = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))))
    values |= {rng.getrandbits(64) for _ in range(40)}
    values = sorted(values)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    got = {r["node"] % (1 << 64): r["root"] for r in simhash.near_links(nodes).collect()}
    root = brute_roots(values, 4)
    groups = {}
    for value, r in zip(values, root):
        groups.setdefault(r, set()).add(value)
    linked = {frozenset(g) for g in groups.values() if len(g) > 1}
    found = {}
    for value, r in got.items():
        found.setdefault(r, set()).add(value)
    assert {frozenset(g) for g in found.values()} == linked


def test_keep_first(odd):
    kept = simhash.keep_first(odd)
    assert kept.schema == odd.schema
    groups = simhash.simhash_components(odd)
    assert kept.count() == groups.select("root").distinct().count()
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    firsts = {r["component"] for r in groups.collect()} - {None}
    assert firsts <= set(ids)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    rows = components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(got)
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty_table(empty):
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


def test_long_text_in_parts():
    words = " ".join(np.random.default_rng(1).integers(0, 10**6, 70_000).astype(str))
    assert simhash.fingerprint(words.encode()) == brute_fingerprint(words)


def test_exploded_tables_are_not_broadcast(spark, monkeypatch, tmp_path):
    plans, plain = {}, simhash.stage

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(simhash, "stage", spy)
    values = [random.Random(3).getrandbits(62) << 1 for _ in range(200)]
    values += [v ^ 5 for v in values[:40]]
    spark.createDataFrame([(v if v < 1 << 62 else -v,) for v in values], "fp bigint").write.parquet(f"{tmp_path}/fps")
    nodes = spark.read.parquet(f"{tmp_path}/fps")  # far below what is broadcast, until it is exploded
    simhash.near_links(nodes).count()
    assert "BroadcastHashJoin" not in plans["simhash-met"] and "SortMergeJoin" in plans["simhash-met"]

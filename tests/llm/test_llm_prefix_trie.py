import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyguard.llm import prefix_trie
from tallyguard.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, pos int, block int, owner string"


def said(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def listed(rows):
    """conv_id -> [(digest, bytes)] in the order of turns."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, said(role, text), len((text or "").encode())))
    return {c: [(d, n) for *_, d, n in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        base = c - int(c - 5 * int(c / 5))
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Every node by its definition, subtrees by walking all nodes below."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(x for x, _ in turns[:d])].append(c)
    size = {tuple(x for x, _ in t[:d]): t[d - 1][1] for t in convs.values() for d in range(1, len(t) + 1)}
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    totals = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [totals[c] for c in children[path]]
        own = (len(nodes[path]) - 1) * size.get(path, 0)
        totals[path] = (sum(x for x, _ in below) or int(not below), own + sum(x for _, x in below))
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        leaves, saved = totals[path]
        out.append((min(members), len(path), parent, len(members), len(children[path]), leaves, saved, digest))
    return sorted(out, key=str)


def rows_of(seed=4):
    """Copies of one long conversation, shared starts of many lengths, nulls, ties and repeats."""
    rng = random.Random(seed)
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i} " + "é" * (i % 5)) for i in range(28)]
    rows = []
    for c in range(-7, 60):
        keep = rng.choice([0, 1, 3, 8, 9, 16, 17, 24, 28])
        own = [(rng.choice([None, "user", "tool"]), rng.choice([None, "", "ok", f"x{c}"])) for _ in range(rng.randrange(0, 20))]
        rows += [(c, i, *t) for i, t in enumerate(turns[:keep] + own)]
    rows += [(100 + c, i, *t) for c in range(40) for i, t in enumerate(turns[:20])]  # copies
    rows += [(200, None, "user", "first"), (200, None, "user", "before"), (200, 3, None, None), (200, 3, "a", "b")]
    rows += [(201, 5, "user", "again")] * 4 + [(201, -1, "user", "start")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    rows += [(c, 0, "user", "alone") for c in range(401, 410)]  # the head of the first four is not there
    rows += [(300, i, "user", "u" * 3000) for i in range(3)]
    rng.shuffle(rows)
    return rows


def table(spark, rows, parts=5):
    extra = ("x", 7, None, "y")
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(parts)


def found(df):
    columns = ("owner", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [3, 8])
def test_trie_against_brute_force(spark, width):
    rows = rows_of()
    turns = prefix_trie.numbered_turns(table(spark, rows))
    everyone = turns.select("conv").distinct()
    assert found(prefix_trie.trie(turns, everyone, width)) == brute(listed(rows))


def test_rebuilt_against_brute_force(spark):
    rows = rows_of(seed=9)
    turns, members = prefix_trie.with_family_heads(prefix_trie.numbered_turns(table(spark, rows)))
    want = brute(rebuilt(listed(rows)))
    assert found(prefix_trie.trie(turns, members)) == want
    assert any(not t for t in rebuilt(listed(rows)).values())  # some lose all turns


def test_one_conversation_holds_a_third_of_the_rows(spark):
    rng = random.Random(1)
    rows = [(3, i, "user", f"t{rng.randrange(9)}") for i in range(700)]
    rows += [(c, i, "user", f"t{i}") for c in range(10, 210) for i in range(rng.randrange(1, 12))]
    turns = prefix_trie.numbered_turns(table(spark, rows, 9))
    assert found(prefix_trie.trie(turns, turns.select("conv").distinct())) == brute(listed(rows))


def test_many_copies_end_at_one_node(spark):
    """More ids than one slice holds; their order is that of the numbers."""
    rows = [(c * 37, 0, "user", "same") for c in range(1500)]
    turns = prefix_trie.numbered_turns(table(spark, rows))
    assert found(prefix_trie.trie(turns, turns.select("conv").distinct())) == brute(listed(rows))


def test_empty_and_turnless(spark):
    none = table(spark, [(1, 1, "a", "b")]).limit(0)
    turns, members = prefix_trie.with_family_heads(prefix_trie.numbered_turns(none))
    assert found(prefix_trie.trie(turns, members)) == []
    only = spark.createDataFrame([(4,), (2,)], "conv bigint")
    digest = hashlib.sha256(b"2,4").hexdigest()
    assert found(prefix_trie.trie(turns, only)) == [(2, 0, None, 2, 0, 1, 0, digest)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = QUERIES["op13_prefix_trie"](spark, sf).collect()
    want = brute(rebuilt(listed([tuple(r) for r in rows])))
    assert sorted(map(tuple, got), key=str) == want

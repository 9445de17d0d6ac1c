import re

import pytest

from tallyguard.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, epochs):
    """sizes by source in order; shares by weight, excess reshared until none is above its cap."""
    target, fixed = {}, {}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        total = sum(w for s, w in weight.items() if s not in fixed)
        target = fixed | {s: left * w / total for s, w in weight.items() if s not in fixed}
        above = {s: epochs * sizes[s] for s in target if s not in fixed and target[s] > epochs * sizes[s]}
        if not above:
            return target
        fixed |= above


def sizes_of(rows):
    sizes = {}
    for row in rows:
        sizes[row["source"]] = sizes.get(row["source"], 0) + len(WORD.findall(row["text"] or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be"))
    return {s: sizes[s] for s in names + [None] * (None in sizes)}


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_mix_meets_targets(odd, range_rows):
    mixed = mixing.mix(odd, range_rows=range_rows).collect()
    assert len(mixed) == odd.count()
    sizes = sizes_of(mixed)
    targets = brute_targets(sizes, mixing.WEIGHTS, mixing.EPOCHS)
    taken = dict.fromkeys(sizes, 0)
    for row in mixed:
        assert row["size"] == len(WORD.findall(row["text"] or ""))
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(targets[row["source"]], abs=1e-6)
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[row["source"]] += row["taken"]
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 1
    again = mixing.mix(odd.repartition(7), range_rows=range_rows).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["taken"])
    assert sorted(map(key, mixed)) == sorted(map(key, again))


def test_targets_with_capped_sources(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 4}, {"a": 3}, {"a": 0}, {"a": 1, "b": 1}):
        rows = [(s, n, 1) for s, n in sizes.items()]
        table = spark.createDataFrame(rows, "source string, source_size bigint, rows bigint")
        got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
        want = brute_targets(sizes, mixing.WEIGHTS, mixing.EPOCHS)
        assert got == pytest.approx(want), sizes


def test_drawn_words_equal_taken_words(odd):
    mixed, drawn = mixing.mix(odd, range_rows=10), mixing.draw(odd, range_rows=10)
    assert drawn.schema == odd.schema
    words = {}
    originals = [r["text"] or "" for r in odd.collect()]
    for row in drawn.collect():
        assert row["text"] in originals or any(o.startswith(row["text"]) for o in originals)
        assert row["n_chars"] is None or row["n_chars"] == len(row["text"])
        words[row["source"]] = words.get(row["source"], 0) + len(WORD.findall(row["text"]))
    taken = {}
    for row in mixed.collect():
        taken[row["source"]] = taken.get(row["source"], 0) + row["taken"]
    assert words == {s: n for s, n in taken.items() if n}


def test_empty_table(empty):
    assert mixing.mix(empty).count() == 0 and mixing.draw(empty).count() == 0

import random
import re

import pytest

from tallyguard.llm import license_scan


def shingles(text):
    words = [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(text, templates=license_scan.TEMPLATES):
    own = shingles(text)
    out = []
    for name in sorted(templates):
        want = shingles(templates[name])
        if want and len(own & want) / len(want) >= 0.8:
            out.append((name, len(own & want), len(want)))
    return out


def planted(n=120):
    """Notices whole, cut or edited, in running text at every offset."""
    rng = random.Random(4)
    filler = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod".split()
    texts = []
    for i in range(n):
        body = license_scan.TEMPLATES[rng.choice(list(license_scan.TEMPLATES))].split()
        if rng.random() < 0.5:
            body[rng.randrange(len(body))] = "edited"
        if rng.random() < 0.3:
            body = body[: rng.randrange(1, len(body))]
        before, after = (rng.choices(filler, k=rng.randrange(0, 40)) for _ in range(2))
        texts.append(" ".join([*before, *body, *after]))
    return texts


def test_against_brute_force(odd, spark):
    texts = odd.select("text").union(spark.createDataFrame([(t,) for t in planted()], "text string"))
    rows = license_scan.scan(texts.selectExpr("text", "text AS copy")).collect()
    assert len(rows) == texts.count()
    for row in rows:
        assert [(x["name"], x["found"], x["size"]) for x in row["licenses"]] == brute(row["copy"])
    assert any(row["licenses"] for row in rows)


def test_every_offset_of_the_shortest_notice(spark):
    texts = ["x y z " * k + "w " * (k % 3) + "released under the MIT license" + " v" * 30 for k in range(25)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert all([x["name"] for x in r["licenses"]] == ["MIT-line"] for r in license_scan.scan(docs).collect())


def test_own_templates_and_bound(spark, odd, monkeypatch):
    own = license_scan.template_table(spark, {"a": "one two three four five six", "short": "one two"})
    docs = spark.createDataFrame([("ONE two, three four five SIX!",), ("one two",), (None,)], "text string")
    got = license_scan.scan(docs, own).collect()
    assert [[x["name"] for x in r["licenses"]] for r in got] == [["a"], [], []]
    monkeypatch.setattr(license_scan, "MAX_SHINGLES", 1)
    with pytest.raises(ValueError):
        license_scan.scan(docs, own)


def test_columns_empty_table_and_plan(odd, empty):
    found = license_scan.scan(odd)
    assert set(found.columns) == (set(odd.columns) - {"text"}) | {"licenses"}
    assert found.count() == odd.count()
    assert license_scan.scan(empty).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_short_notice_is_lost(spark):
    """A five-word notice near the start lies in few windows; what surrounds it must not matter."""
    rng = random.Random(29)
    words = lambda n: " ".join("".join(rng.choices("aeinorst", k=6)) for _ in range(n))
    texts = [f"{words(i % 4)} released under the mit license {words(20)}" for i in range(6000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    lost = license_scan.scan(docs).filter("size(licenses) = 0").select("doc_id").collect()
    assert lost == []

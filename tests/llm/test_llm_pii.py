import re

import numpy as np

from tallyguard.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in BASE.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]


HARD = [
    "a@b.cc%d@e.ff x@y@z.com a@b a@b. @c.de a..b@-.- é@é.com ü.a@b.c.d.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 .1.2.3.4 12.34.56.78a 0.0.0.0000256 0.0.0.00255",
    "4111111111111111 4111 1111-1111 1111 41111111111111112 0000000000000 1 2 3 4 5 6 7 8 9 0 1 2 3",
    "+1 +1( )2 +44 20 7946 0958 ++49.30.901820 +123456789 +12345678 +1234567890123456 + 1 +1----",
    "\U0001f600é +33 1 23 45 67 89 \U0001f600 a@b.co 10.0.0.1 5500 0000 0000 0004",
    "a@b.c" * 50 + " 1.1.1.1" * 100,
    "a@" * 2000 + "b.c",
    "9" * 3000 + ".1.1.1 " + "+9" + "(" * 3000,
]


def test_base_spans_against_brute_force(odd, spark):
    texts = odd.select("text").union(spark.createDataFrame([(t,) for t in HARD], "text string"))
    rows = pii.find(texts.selectExpr("text", "text AS copy")).collect()
    assert len(rows) == texts.count()
    for row in rows:
        got = [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["base"]]
        assert got == brute(row["copy"])
        order = [(pii.KINDS.index(s["kind"]), s["start"]) for s in row["spans"]]
        assert order == sorted(order)


def test_very_long_domains_do_not_overflow(spark):
    text = "x@" + "a." * 200_000 + "b " + "1-" * 100_000 + "1 " + "1." * 100_000 + "1"
    row = pii.find(spark.createDataFrame([(text,)], "text string").selectExpr("text", "1 AS k")).first()
    assert ("email", 0, 2 + 400_000 + 1) in [(s["kind"], s["start"], s["end"]) for s in row["spans"]]


def test_trees_select_spans_the_base_misses(spark):
    """Phones after a cue: with most written with a plus, those without one are found too."""
    rows = []
    for i in range(400):
        a, b = 1000 + 7 * i, 2000 + 3 * i
        phone = f"+44 20 {a} {b}" if i % 20 else f"44 20 {a} {b}"
        rows.append((i, f"please call {phone} today or see order {10**6 + i} 44 {a} {i % 10}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for i, text in rows:
        added = [text[s["start"] : s["end"]] for s in found[i] if not s["base"]]
        phone = text.split("call ")[1].split(" today")[0]
        assert added == ([] if i % 20 else [phone])


def test_two_cards_in_a_row(spark):
    """The base sees one number that is too long; the overlapping proposals find both."""
    def card(i):
        body = f"4{i:014d}"
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    rows = [(i, f"paid with {card(i)} on time") for i in range(200)]
    rows.append((999, f"paid with {card(500)} {card(501)} on time"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert [(s["start"], s["end"], s["base"]) for s in found[999]] == [(10, 26, False), (27, 43, False)]
    assert all(len(found[i]) == 1 and found[i][0]["base"] for i in range(200))


def test_clean_text_stays_clean(spark):
    rows = [(i, f"there were {i} birds and {1000 + i} trees in 20{i % 90 + 10}, page 12-{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r["spans"] == [] for r in pii.find(docs).collect())


def test_boosting_and_threshold():
    x = pii.GENERATORS[1].cells()
    n = np.full(len(x), 50.0)
    true = np.where((x[:, 0] == 3) & (x[:, 3] == 1), 50.0, 0.0)
    score = pii.boosted(x, n, true)
    at = pii.threshold(score, n, true, 0.9)
    assert np.array_equal(score >= at, true > 0)
    assert pii.threshold(score, n, np.zeros(len(x)), 0.9) == float("inf")


def test_redaction(spark):
    text = "write to a.b@c.de or +44 20 7946 0958 é 10.0.0.1"
    docs = spark.createDataFrame([(1, text), (2, None), (None, "x@y.zz")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    want = text
    for _, s, e in brute(text):
        want = want[:s] + "*" * (e - s) + want[e:]
    assert got == {1: want, 2: None, None: "******"}


def test_extra_columns_and_empty_table(odd, empty):
    found = pii.find(odd)
    assert set(found.columns) == set(odd.columns) - {"text"} and found.count() == odd.count()
    assert pii.find(empty).count() == 0


def test_no_python_in_the_plan(odd):
    plan = pii.find(odd.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

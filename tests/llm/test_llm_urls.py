import math
import re
from collections import Counter, defaultdict

import pytest

from tallyguard.llm import urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def brute(rows, depth=urls.DEPTH, z=urls.Z, least=urls.MIN_PAGES, alpha=urls.ALPHA):
    """Verdict per (host, path), the tree walked node by node."""
    counts, blocked = Counter(), Counter()
    for url in rows:
        key = parse(url)
        rule = rule_of(*key)
        counts[key] += 1
        blocked[key] += rule is not None and rule[0] == "block"
    prior = sum(blocked.values()) / max(1, sum(counts.values()))
    out = {}

    def walk(keys, level, above):
        n, b = sum(counts[k] for k in keys), sum(blocked[k] for k in keys)
        purity = (b + alpha * above) / (n + alpha)
        named = defaultdict(list)
        for k in keys:
            segments = [s for s in k[1].split("/") if s]
            if level >= depth or len(segments) <= level:
                out[k] = purity
            else:
                segment = segments[level]
                named["*" if re.search(urls.VARIABLE, segment) else segment].append(k)
        sums = {s: (sum(counts[k] for k in ks), sum(blocked[k] for k in ks)) for s, ks in named.items()}
        groups = defaultdict(list)
        for s, (cn, cb) in sums.items():
            if s != "*" and cn >= least:
                groups[sum(8 * cb >= e * cn for e in urls.SHARES)].append(s)
        children = defaultdict(list)
        for s, ks in named.items():
            name = "*"
            for number, members in groups.items():
                if s in members:
                    name = f"*{number}"
                    cn, cb = sums[s]
                    all_n, all_b = (sum(sums[m][i] for m in members) for i in (0, 1))
                    if all_n > cn:
                        p, rest = all_b / all_n, all_n - cn
                        error = math.sqrt(p * (1 - p) * (1 / cn + 1 / rest))
                        if abs(cb / cn - (all_b - cb) / rest) > z * error:
                            name = s
            children[name] += ks
        for ks in children.values():
            walk(ks, level + 1, purity)

    hosts = defaultdict(list)
    for k in counts:
        hosts[k[0]].append(k)
    for ks in hosts.values():
        walk(ks, 0, prior)
    return out


ODD = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://EXAMPLE.net/EN/x",
    "http://Example.NET/en/a",
    "http://example.net/en",
    "http://net/",
    "http://net",
    "http://x.net?q=/en/",
    "ftp://a.b.org/fr/x#/y",
    "http://borg/fr/x",
    "http://sub.example.com/de/",
    "http://É.com/de//a///b",
    "a://b://c/d",
    "http://h.com/" + "x/" * 500,
]


def urls_of(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    more = [f"http://shop.com/{s}/{i % 40}" for i in range(300) for s in ("ok", "spam", "news", f"t{i % 3}")]
    return [r["url"] for r in pages.collect()] + ODD + more


def test_parts_and_rules(spark):
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls_of(spark))], "page_id bigint, url string")
    for row in urls.judge(table).collect():
        host, path = parse(row["url"])
        rule = rule_of(host, path)
        assert (row["host"], row["path"]) == (host, path)
        assert row["rule"] == (rule and rule[1] + rule[2])
        if rule:
            assert row["verdict"] == rule[0]


def test_verdicts_against_brute_force(spark):
    listed = urls_of(spark)
    purity = brute(listed)
    table = spark.createDataFrame([(i, u) for i, u in enumerate(listed)], "page_id bigint, url string")
    rows = urls.judge(table).collect()
    assert len(rows) == len(listed)
    for row in rows:
        key = parse(row["url"])
        assert row["purity"] == pytest.approx(purity[key])
        rule = rule_of(*key)
        assert row["verdict"] == (rule[0] if rule else "block" if row["purity"] >= 0.5 else "allow")


def test_labels_separate_a_branch(spark):
    rows = [(f"http://shop.com/{s}/{i}", s == "spam") for i in range(100) for s in ("spam", "news", "ok")]
    rows += [("http://shop.com/spam/new", None), ("http://shop.com/fresh/1", None)]
    table = spark.createDataFrame(rows, "url string, bad boolean")
    judged = urls.judge(table, rules=(), blocked="bad")
    got = {r["url"]: (r["verdict"], r["template"]) for r in judged.collect()}
    assert got["http://shop.com/spam/new"] == ("block", "/*3/*")
    assert got["http://shop.com/fresh/1"] == ("allow", "/*/*")
    assert got["http://shop.com/news/7"] == ("allow", "/*0/*")


def test_clashing_columns_and_empty_table(spark):
    schema = "page_id bigint, url string, host string, path int, rule string, verdict string, n int"
    table = spark.createDataFrame([(1, "http://a.net/x", "h", 1, "r", "v", 3), (1, None, *[None] * 5)] * 2, schema)
    got = urls.judge(table)
    assert got.count() == 4 and set(table.columns) <= set(got.columns)
    assert {r["verdict"] for r in got.filter("url IS NOT NULL").collect()} == {"block"}
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = urls.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pages_without_a_label_are_not_clean(spark):
    """One page in ten has a label; all labels of /spam/ are bad."""
    rows = [
        (f"http://shop.com/{s}/{i}", s == "spam" if i % 10 == 0 else None)
        for i in range(1000)
        for s in ("spam", "news", "ok")
    ]
    table = spark.createDataFrame(rows, "url string, bad boolean")
    got = urls.judge(table, rules=(), blocked="bad").groupBy("template", "verdict").count().collect()
    assert {(r["template"], r["verdict"], r["count"]) for r in got} == {
        ("/*3/*", "block", 1000),
        ("/*0/*", "allow", 2000),
    }


def test_inherited_purity_blocks_nothing(spark):
    """All labels of the host are bad, but they speak about one branch only."""
    rows = [(f"http://shop.com/spam/{i}", True) for i in range(100)]
    rows += [(f"http://shop.com/other/{i}", None) for i in range(100)]
    table = spark.createDataFrame(rows, "url string, bad boolean")
    for row in urls.judge(table, rules=(), blocked="bad").collect():
        assert row["verdict"] == ("block" if "/spam/" in row["url"] else "allow")
        assert row["purity"] > 0.5  # inherited where the template has no labels


def test_branches_below_the_fixed_levels(spark):
    """What parts the pages is the fourth segment, or the sixth."""
    rows = [(f"http://shop.com/a/b/c/{s}/{i}", s == "spam") for i in range(100) for s in ("spam", "news", "ok")]
    rows += [(f"http://deep.com/a/b/c/d/e/{s}/x/{i}", s == "spam") for i in range(100) for s in ("spam", "ok")]
    table = spark.createDataFrame(rows, "url string, bad boolean")
    got = urls.judge(table, rules=(), blocked="bad").collect()
    assert len(got) == len(rows)
    assert all(r["verdict"] == ("block" if r["bad"] else "allow") for r in got)
    assert {r["template"] for r in got if r["bad"]} == {"/*1/*1/*1/*3/**", "/*2/*2/*2/*2/*2/*3/**"}

import re
from collections import Counter

from tallyguard.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def test_counts_against_brute_force(odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count()
    for row in rows:
        want = brute(row["text"])
        assert {k: row[k] for k in want} == want
        if row["base_failed"]:
            assert row["kept"] is False


def test_overlapping_repeats(spark):
    texts = ["a b c d e " * 4, "a b c d e f a b c d e", "a a a a a a", "a a a a a", "x y z w v " + "x y z w v"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["n_repeat_words"] for r in quality.judge(docs).collect()}
    assert got == {t: brute(t)["n_repeat_words"] for t in texts}


def test_rules_reject_junk_and_keep_prose(spark):
    prose = "It was the best of times and it was the worst of times, as some have said. " * 1
    junk = " ".join(f"w{i}###$$$" for i in range(40))
    docs = spark.createDataFrame([(prose,), (junk,)], "text string")
    got = [r["kept"] for r in quality.judge(docs).orderBy("n_symbols").collect()]
    assert got == [True, False]
    loose = (quality.Rule("symbols_per_word", None, 100.0),)
    assert all(r["kept"] for r in quality.judge(docs, loose).collect())


def test_keep_good_keeps_rows_as_they_are(odd):
    good = quality.keep_good(odd)
    assert good.schema == odd.schema
    want = [r["n"] for r in quality.judge(odd.withColumnRenamed("kept", "kept_")).filter("kept").collect()]
    assert sorted(r["n"] or -1 for r in good.collect()) == sorted(w or -1 for w in want)


def test_no_user_functions_and_no_shuffle(odd):
    plan = quality.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.replace("Scan ExistingRDD", ""))


def test_empty_table(empty):
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0

"""Quality rules: a table of thresholds compiled into one projection.

Each rule names a measure of the text and the range it must lie in. ``judge`` adds the
measures and the verdict to every row; nothing is shuffled and no user function runs.

A null text has no words. A measure that is undefined (no words, no lines, too few words for
stop words) is null and passes its rule, so only the base rule speaks about empty texts (they
fail it: fewer than ten words). Extra
columns stay; a column that bears the name of an added one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, indices, let, total, words

# Short function words of the languages in view.
STOP_WORDS = (
    "the of and to in is that it for on with as was "
    "le la les de des et que qui une du est pour dans "
    "el los las y en por con una se del "
    "der die das und ist von zu den mit ein im"
).split()
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
ENOUGH_WORDS = 30  # below it the share of stop words says nothing


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; an open end is None."""

    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.col(f"_quality_measures.{self.measure}")
        ends = [value >= self.low] if self.low is not None else []
        ends += [value <= self.high] if self.high is not None else []
        passes = F.lit(True)
        for end in ends:
            passes = passes & end
        return F.coalesce(passes, F.lit(True))


RULES = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_share", 0.005, 0.95),
    Rule("duplicate_line_share", None, 0.5),
    Rule("longest_word", None, 1000.0),
    Rule("mean_line_words", 1.0, None),
)


def _repeated_words(ws: Column) -> Column:
    """Words that lie in a window of five words which the text holds twice or more.

    Windows are compared by a 64-bit hash. Only a text with a repeated window sorts them; the
    union of [p, p + 5) over the sorted repeated positions is a sum over neighbours.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return let(
                F.sort_array(F.transform(same, lambda x: x["i"])),
                lambda p: total(
                    F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.get(p, k + 1) - v))
                ),
            )

        return let(ordered, twins)

    hashes = F.transform(
        indices(F.size(ws) - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]),
    )
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(
            F.lit(0).cast("bigint")
        ),
    )


def _measures(text: Column) -> Column:
    """All counts of a text as one struct, the words split once."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def counts(ws: Column) -> Column:
        n = F.size(ws).cast("bigint")
        return F.struct(
            n.alias("n_words"),
            _repeated_words(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS)))
            .cast("bigint")
            .alias("n_stop_words"),
            F.coalesce(F.array_max(F.transform(ws, F.length)), F.lit(0)).alias("longest_word"),
        )

    return F.struct(
        let(words(text), counts).alias("w"),
        F.length(F.translate(whole, _SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")))
        .cast("bigint")
        .alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("bigint").alias("n"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
            ),
        ).alias("lines"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    ``kept`` is false where the base rule fails (fewer than ten words, or over a fifth of
    them in repeated windows of five) or a rule of the table does.
    """
    c = _measures(F.col(text))
    out = docs.withColumn("_quality_counts", c)
    g = lambda name: F.col(f"_quality_counts.{name}")
    out = out.withColumn(
        "_quality_measures",
        F.struct(
            _ratio(g("word_chars"), g("w.n_words")).alias("mean_word_length"),
            _ratio(g("n_symbols"), g("w.n_words")).alias("symbols_per_word"),
            F.when(g("w.n_words") >= ENOUGH_WORDS, g("w.n_stop_words") / g("w.n_words")).alias(
                "stop_word_share"
            ),
            _ratio(g("lines.dup"), g("lines.n")).alias("duplicate_line_share"),
            g("w.longest_word").cast("double").alias("longest_word"),
            _ratio(g("w.n_words"), g("lines.n")).alias("mean_line_words"),
        ),
    )
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.holds()
    failed = (g("w.n_words") < 10) | (100 * g("w.n_repeat_words") > 20 * g("w.n_words"))
    return out.withColumns(
        {
            "n_words": g("w.n_words"),
            "word_chars": g("word_chars"),
            "n_symbols": g("n_symbols"),
            "n_dup_lines": g("lines.dup"),
            "n_repeat_words": g("w.n_repeat_words"),
            "base_failed": failed,
            "kept": ~failed & verdict,
        }
    ).drop("_quality_measures", "_quality_counts")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass all rules, with their own columns only."""
    marked = judge(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), rules, "_text")
    return marked.filter("kept").select("_row.*")

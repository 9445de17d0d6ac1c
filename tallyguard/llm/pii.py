"""Personal data: base patterns, and further spans proposed generously and chosen by boosted trees.

Base spans (email, ip, card, phone) follow fixed patterns with a validity test and are always
reported. Beside them, generators of high recall propose overlapping spans: anything like an
address with an at sign, spelled out or not, any long number, which is proposed as a phone
number, a card and an ip at once, and any run of digits as long as a card's. Format and context (number of digits, groups, separators, the
word before) are binned into a cell; the cells are a finite set. Over the whole corpus each
cell's spans are counted, those that pass the base test apart; what the base test itself looks
at (the plus sign, the check digit, the at sign's form) is no feature. Boosted trees are
fitted to the counts of one half of the documents, per kind; the other half calibrates the
threshold: the lowest score down to which the spans of every score are true to the share
``precision``. The trees are evaluated on every cell once, and spans in cells above the threshold are reported if
they do not overlap a base span. Driver and plan hold cells, never spans.

Positions are code points, ends exclusive. Possessive patterns keep matching linear in the
text; they match exactly what the plain forms do. A null text has no spans. Extra columns
stay; one that bears the name of the added column is replaced. Rows are independent but for the
counts; an empty table gives an empty result and selects no cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from .text import let, running_sum, total

KINDS = ("email", "ip", "card", "phone")
PRECISION, ROUNDS, RATE = 0.9, 30, 0.3
MIN_SPANS = 20  # of calibration that a threshold must rest on

# The base patterns, in forms that match the same and never go back.
_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = rf"^[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"
LIKE_EMAIL = (
    rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+"
)
LIKE_NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++"
LIKE_CARD = r"(?<![0-9])[0-9]{13,19}+(?![0-9])"  # also where the base sees one longer number
_CUES = (
    r"^(tel|phone|telephone|call|mobile|fax|telefon|telefono|tel.fono|anruf|appel)$",
    r"^(card|visa|mastercard|credit|tarjeta|carte|karte|iban|account)$",
    r"^(ip|host|server|address|addr|router)$",
    r"^(mail|email|e|contact|write|correo|courriel)$",
)
_CONTEXT = 24  # characters before a span that are looked at


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value, before)."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

        def spans(gap: Column) -> Column:
            steps = F.zip_with(gap, found, lambda g, v: (F.length(g) + F.length(v)).cast("bigint"))
            joined = F.arrays_zip(running_sum(steps).alias("e"), found.alias("v"), gap.alias("g"))
            return F.transform(
                joined,
                lambda x: F.struct(
                    (x["e"] - F.length(x["v"])).cast("int").alias("start"),
                    x["e"].cast("int").alias("end"),
                    x["v"].alias("value"),
                    F.right(x["g"], F.lit(_CONTEXT)).alias("before"),
                ),
            )

        return F.when(F.size(found) > 0, let(gaps, spans)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def summed(backwards: Column) -> Column:
        digit = lambda i: F.substring(backwards, i, F.lit(1))
        doubled = lambda i: F.translate(digit(i), "0123456789", "0246813579")
        value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(doubled(i)).cast("int")
        return total(F.transform(F.sequence(F.lit(1), F.length(backwards)), value))

    return let(F.reverse(digits), summed) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The base test of a whole value, a match of the base pattern or a proposed span."""
    if kind == "email":
        return value.rlike(_EMAIL)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        fits = F.length(digits).between(13, 19) & value.rlike(r"^[0-9](?:[\x20-]?[0-9])++$")
        return F.when(fits, _luhn(digits)).otherwise(F.lit(False))
    return F.length(_digits(value)).between(9, 15) & value.startswith("+")


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end) by kind as listed, then start."""

    def of(kind: str) -> Column:
        valid = F.filter(matches(text, BASE[kind]), lambda m: passes(kind, m["value"]))
        return F.transform(
            valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"], m["end"])
        )

    return F.concat(*[of(kind) for kind in KINDS])


def _cue(before: Column) -> Column:
    word = F.regexp_extract(F.lower(before), r"([a-z]++)[^a-z]*+$", 1)
    out = F.lit(0)
    for i, pattern in enumerate(_CUES):
        out = F.when(word.rlike(pattern), i + 1).otherwise(out)
    return out


def _bin(value: Column, ends: tuple[int, ...]) -> Column:
    """Number of ``ends`` that the value exceeds."""
    out = F.lit(0)
    for i, end in enumerate(ends):
        out = F.when(value > end, i + 1).otherwise(out)
    return out


@dataclass(frozen=True)
class Generator:
    """A loose pattern, the sizes of its binned features, and the kinds it proposes."""

    pattern: str
    kinds: tuple[str, ...]
    sizes: tuple[int, ...]

    def features(self, value: Column, before: Column) -> list[Column]:
        if self.kinds == ("email",):
            domain = F.regexp_extract(value, r"(?:@|\(at\)|\[at\])(.*)$", 1)
            last = F.regexp_extract(value, r"([A-Za-z0-9-]*+)$", 1)
            return [
                _bin(F.regexp_count(domain, F.lit("[A-Za-z0-9-]+")), (1, 2, 3)),
                _bin(F.length(last), (1, 2, 3, 4)),
                _bin(F.length(value), (8, 16, 32)),
                _cue(before),
            ]
        separators = F.regexp_replace(value, "^[+(]|[0-9]", "")
        kind = (
            F.when(separators == "", 0)
            .when(separators.rlike("^\\x20+$"), 1)
            .when(separators.rlike("^-+$"), 2)
            .when(separators.rlike("^\\.+$"), 3)
            .otherwise(4)
        )
        return [
            _bin(F.length(_digits(value)), (8, 10, 12, 15, 16, 19)),
            _bin(F.regexp_count(value, F.lit("[0-9]+")), (1, 2, 3, 4)),
            kind,
            _cue(before),
        ]

    def cell(self, value: Column, before: Column) -> Column:
        code = F.lit(0)
        for size, feature in zip(self.sizes, self.features(value, before)):
            code = code * size + feature
        return code

    def cells(self) -> np.ndarray:
        """The features of every cell, one row each, in the order of the codes."""
        return np.stack(np.unravel_index(np.arange(np.prod(self.sizes)), self.sizes), axis=1)

    def proposals(self, text: Column) -> Column:
        found = F.filter(
            matches(text, self.pattern),
            lambda m: F.length(_digits(m["value"])) >= 7 if len(self.kinds) > 1 else F.lit(True),
        )
        return F.transform(
            found,
            lambda m: F.struct(
                m["start"],
                m["end"],
                self.cell(m["value"], m["before"]).alias("cell"),
                F.array(*[passes(k, m["value"]) for k in self.kinds]).alias("true"),
            ),
        )


GENERATORS = (
    Generator(LIKE_EMAIL, ("email",), (4, 5, 4, 5)),
    Generator(LIKE_NUMBER, ("ip", "card", "phone"), (7, 5, 5, 5)),
    Generator(LIKE_CARD, ("card",), (7, 5, 5, 5)),
)


def _best_split(x: np.ndarray, gain: np.ndarray, weight: np.ndarray) -> tuple[float, int, int]:
    """(improvement, feature, largest value that goes left) for sums of gradients and weights."""
    best = (0.0, 0, -1)
    whole = gain.sum() ** 2 / (weight.sum() + 1.0)
    for f in range(x.shape[1]):
        g = np.cumsum(np.bincount(x[:, f], gain))
        h = np.cumsum(np.bincount(x[:, f], weight))
        score = g**2 / (h + 1.0) + (g[-1] - g) ** 2 / (h[-1] - h + 1.0) - whole
        at = int(score[:-1].argmax()) if len(score) > 1 else 0
        if len(score) > 1 and score[at] > best[0]:
            best = (float(score[at]), f, at)
    return best


def boosted(x: np.ndarray, n: np.ndarray, true: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Scores of all cells: trees of depth two, boosted on the logistic loss of counted cells."""
    score = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gain, weight = true - n * p, n * p * (1 - p)
        _, f, at = _best_split(x, gain, weight)
        for side in (x[:, f] <= at, x[:, f] > at):
            _, f2, at2 = _best_split(x[side], gain[side], weight[side]) if side.any() else (0, 0, -1)
            for leaf in (side & (x[:, f2] <= at2), side & (x[:, f2] > at2)):
                score[leaf] += RATE * gain[leaf].sum() / (weight[leaf].sum() + 1.0)
    return score


def threshold(score: np.ndarray, n: np.ndarray, true: np.ndarray, precision: float) -> float:
    """Lowest score down to which the spans of every score are true often enough.

    inf if fewer than ``MIN_SPANS`` calibration spans lie there.
    """
    levels, level = np.unique(-score, return_inverse=True)
    spans, right = np.bincount(level, n), np.bincount(level, true)
    seen = np.flatnonzero(spans > 0)
    wrong = seen[right[seen] < precision * spans[seen]]
    good = seen[seen < (wrong[0] if len(wrong) else len(levels))]
    return float(-levels[good[-1]]) if spans[good].sum() >= MIN_SPANS else float("inf")


def _selected(found: DataFrame, number: int, precision: float) -> dict[str, list[int]]:
    """The cells of a generator whose spans are reported, per kind."""
    generator = GENERATORS[number]
    spans = found.select("half", F.explode(f"like_{number}").alias("s"))
    counted = spans.groupBy("half", F.col("s.cell").alias("cell")).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("s.true")[i].cast("bigint")).alias(k) for i, k in enumerate(generator.kinds)],
    )
    x = generator.cells()
    n = np.zeros((2, len(x)))
    true = {k: np.zeros((2, len(x))) for k in generator.kinds}
    for row in counted.collect():  # at most two rows per cell
        n[row["half"], row["cell"]] = row["n"]
        for kind in generator.kinds:
            true[kind][row["half"], row["cell"]] = row[kind]
    chosen = {}
    for kind in generator.kinds:
        score = boosted(x, n[0], true[kind][0])
        chosen[kind] = np.flatnonzero(score >= threshold(score, n[1], true[kind][1], precision)).tolist()
    return chosen


def _picked(proposals: str, kind: str, cells: list[int]) -> Column:
    """Spans of one kind in the selected cells."""
    chosen = F.filter(proposals, lambda s: s["cell"].isin(cells))
    return F.transform(chosen, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"]))


def find(
    docs: DataFrame,
    text: str = "text",
    out: str = "spans",
    precision: float = PRECISION,
) -> DataFrame:
    """Add the array of (kind, start, end, base) by kind as listed, then start.

    All columns but the text travel with the spans through the staged table.
    """
    own = [c for c in docs.columns if c not in (text, out)]
    plain = F.coalesce(F.col(text), F.lit(""))
    row = docs.select(
        F.struct(*own).alias("_row") if own else F.lit(True).alias("_row"), plain.alias("_text")
    )
    half = F.pmod(F.xxhash64("_text"), F.lit(2)).cast("int")
    read = row.select(
        "_row",
        half.alias("half"),
        base_spans(F.col("_text")).alias("base"),
        *[g.proposals(F.col("_text")).alias(f"like_{i}") for i, g in enumerate(GENERATORS)],
    )
    found = stage(read, "pii-found")
    more = []
    for number, generator in enumerate(GENERATORS):
        chosen = _selected(found, number, precision)
        more += [
            _picked(f"like_{number}", kind, chosen[kind])
            for kind in generator.kinds
            if chosen[kind]
        ]
    base = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"], F.lit(True).alias("base")))
    spans = base
    if more:
        clear = F.filter(
            F.array_except(F.concat(*more), "base"),  # each span once, those of the base left out
            lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        added = F.transform(clear, lambda s: F.struct(s["kind"], s["start"], s["end"], F.lit(False).alias("base")))
        listed = F.array(*[F.lit(k) for k in KINDS])
        keyed = F.transform(
            F.concat(base, added), lambda s: F.struct(F.array_position(listed, s["kind"]).alias("k"), s["start"], s.alias("s"))
        )
        spans = F.transform(F.sort_array(keyed), lambda s: s["s"])
    return found.select(*[F.col("_row")[c].alias(c) for c in own], spans.alias(out))


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mask: str = "*") -> DataFrame:
    """``docs`` (one row per id) with every found span overwritten by as many mask characters."""
    spans = find(docs.select(id_col, text), text).select(F.col(id_col).alias("_id"), "spans")
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("_id")))
    hidden = F.aggregate(
        "spans",
        F.col(text),
        lambda t, s: F.concat(
            F.substring(t, F.lit(1), s["start"]),
            F.repeat(F.lit(mask), s["end"] - s["start"]),
            F.substring(t, s["end"] + 1, F.length(t)),
        ),
    )
    return joined.withColumn(text, hidden).select(*docs.columns)

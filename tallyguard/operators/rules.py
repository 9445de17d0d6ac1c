"""Detection rules.

Each rule maps a book with a microsecond clock ``us`` to the transaction ids it flags;
rules that look at one row only are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numbers import at_least_share, cents, in_band, is_whole
from ..functions.text import reason_text
from ..plans import HotKeys, find_hot, paired, running
from ..plans.skew import CHUNK

SIDES = ("receiver", "sender")
ROW = "row_key"


def with_clock(df: DataFrame) -> DataFrame:
    if "us" in df.columns:
        return df
    return df.withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``row_key``, by which flags and scores of one row meet where ids repeat.

    128 hash bits of the row; rows that are alike in every column share one.
    """
    if ROW in df.columns:
        return df
    own = sorted(df.columns)
    halves = [F.hex(F.xxhash64(*own)), F.hex(F.xxhash64(F.lit("row"), *own))]
    return df.withColumn(ROW, F.concat(*halves))


def _hot(df: DataFrame, hot: HotKeys | None) -> HotKeys:
    return find_hot(df) if hot is None else hot


def by_side(df: DataFrame, columns: Iterable[str] = ("transaction_id", "us")) -> DataFrame:
    """Each payment once per leg, sides kept apart."""
    legs = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("side"), F.col(f"{s}_account").alias("account"))
                for s in SIDES
            ]
        )
    )
    return df.select(legs.alias("leg"), *columns).select(
        "leg.side", "leg.account", *columns
    ).filter("account IS NOT NULL AND us IS NOT NULL")


def _burst(window, width: int, k: int) -> Column:
    """Does the row sit in a run of ``k`` neighbours no wider than ``width``?

    A window holding at least ``k`` events around a row also holds ``k`` consecutive
    ones around it, so only the ``k - 1`` neighbours on either side matter.
    """
    starts = F.lead("us", k - 1).over(window) - F.col("us") <= width
    return starts


def structuring(
    book: DataFrame,
    threshold: float = C.REPORTING_THRESHOLD,
    band_low: float = C.BAND_LOW,
    window_days: float = C.BURST_DAYS,
    min_count: int = C.BURST_MIN_COUNT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Payments in a burst of just-below-threshold payments of one account.

    Sender and receiver sides are separate timelines. Chunks of a hot account are
    searched on their own; a run across chunks consists of the outermost ``k - 1`` rows
    of its chunks, so those few rows are searched once more together. (Leaving out rows
    in between only makes such a run look sparser than it is, never denser.)
    """
    near = with_clock(book).filter(in_band(F.col("amount"), threshold, band_low))
    hot = _hot(near, hot)
    width, k = round(window_days * C.DAY), min_count
    legs = hot.split_in_order(by_side(near), ["side", "account"], ["us", "transaction_id"])
    found = _flag_bursts(legs, ["side", "account", CHUNK], width, k)
    hits = found.filter("in_burst").select("transaction_id")
    if hot and k > 1:
        place = Window.partitionBy("side", "account", CHUNK)
        first = F.row_number().over(place.orderBy("us", "transaction_id"))
        last = F.row_number().over(place.orderBy(F.desc("us"), F.desc("transaction_id")))
        split = legs.filter(F.col(CHUNK) >= 0)
        edges = (
            split.withColumns({"_first": first, "_last": last})
            .filter(F.least("_first", "_last") <= k - 1)
            .select(*legs.columns)
        )
        across = _flag_bursts(edges, ["side", "account"], width, k)
        hits = hits.union(across.filter("in_burst").select("transaction_id"))
    return hits.distinct()


def _flag_bursts(legs: DataFrame, keys: list[str], width: int, k: int) -> DataFrame:
    timeline = Window.partitionBy(*keys).orderBy("us", "transaction_id")
    if k <= 1:
        return legs.withColumn("in_burst", F.lit(True))
    return legs.withColumn("_starts", _burst(timeline, width, k)).withColumn(
        "in_burst",
        F.coalesce(F.max("_starts").over(timeline.rowsBetween(-(k - 1), 0)), F.lit(False)),
    )


def rapid_movement(
    book: DataFrame,
    window_hours: float = C.PASS_HOURS,
    passthrough: str = C.PASS_SHARE,
    min_amount: float = C.PASS_MIN_AMOUNT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Credits mostly paid out again within the window, and the debits that did it.

    Debits after a credit are the difference of two running totals, read at the credit
    and at the end of its window. A debit is flagged when the latest qualifying credit
    before it is no older than the window. Both passes run over one account timeline
    and share its shuffle.
    """
    rows = with_clock(book).filter("us IS NOT NULL")
    hot = _hot(rows, hot)
    width = round(window_hours * C.HOUR)
    money = cents(F.col("amount"))
    # kinds sort in this order at one instant: a debit, then what reads totals
    debit, opens, closes = 0, 1, 2
    part = F.struct
    as_debit = part(
        F.lit(debit).alias("kind"), F.col("sender_account").alias("account"),
        F.col("us").alias("us"), money.alias("out_cents"), F.lit(None).cast("bigint").alias("in_cents"),
    )
    as_open = part(
        F.lit(opens).alias("kind"), F.col("receiver_account").alias("account"),
        F.col("us").alias("us"), F.lit(None).cast("bigint").alias("out_cents"), money.alias("in_cents"),
    )
    as_close = part(
        F.lit(closes).alias("kind"), F.col("receiver_account").alias("account"),
        (F.col("us") + width).alias("us"), F.lit(None).cast("bigint").alias("out_cents"),
        money.alias("in_cents"),
    )
    timeline = (
        rows.select(
            "transaction_id",
            F.col("us").alias("us0"),
            F.explode(
                F.when(F.col("amount") >= min_amount, F.array(as_debit, as_open, as_close))
                .otherwise(F.array(as_debit))
            ).alias("e"),
        )
        .select("transaction_id", "us0", "e.*")
        .filter("account IS NOT NULL")
    )
    order = ["us", "kind", "transaction_id"]
    totals = running(timeline, ["account"], order, {"paid_out": ("sum", "out_cents")}, hot)
    read = paired(
        totals,
        ["account", "transaction_id", "us0"],
        {
            "at_open": F.when(F.col("kind") == opens, F.coalesce("paid_out", F.lit(0))),
            "at_close": F.when(F.col("kind") == closes, F.coalesce("paid_out", F.lit(0))),
        },
    ).filter(F.col("kind") != closes)
    moved = F.col("at_close") - F.col("at_open")
    # something must have left: a share of nothing is not a pass-through
    qualifies = (F.col("kind") == opens) & (moved > 0) & at_least_share(
        moved, passthrough, F.col("in_cents")
    )
    marked = read.withColumn("credit_us", F.when(qualifies, F.col("us"))).select(
        "account", "us", "kind", "transaction_id", "credit_us"
    )
    latest = running(
        marked, ["account"], order, {"latest_credit": ("max", "credit_us")}, hot, include_self=False
    )
    return (
        latest.filter(
            F.col("credit_us").isNotNull()
            | ((F.col("kind") == debit) & (F.col("latest_credit") >= F.col("us") - width))
        )
        .select("transaction_id")
        .distinct()
    )


def is_high_risk(countries: Iterable[str] = C.HIGH_RISK_COUNTRIES) -> Column:
    """Either leg touches a listed jurisdiction; an unknown country does not."""
    legs = [F.col(f"{s}_country").isin(*countries) for s in SIDES]
    return F.coalesce(legs[0], F.lit(False)) | F.coalesce(legs[1], F.lit(False))


def exposure(countries: Iterable[str] = C.HIGH_RISK_COUNTRIES) -> Column:
    sender = F.coalesce(F.col("sender_country").isin(*countries), F.lit(False))
    receiver = F.coalesce(F.col("receiver_country").isin(*countries), F.lit(False))
    return F.when(sender & receiver, "both legs").when(sender, "sender").otherwise("receiver")


def is_round(min_amount: float = C.ROUND_MIN_AMOUNT) -> Column:
    amount = F.col("amount")
    return is_whole(amount) & (amount >= min_amount)


def high_risk_country(
    book: DataFrame, countries: Iterable[str] = C.HIGH_RISK_COUNTRIES
) -> DataFrame:
    return book.filter(is_high_risk(countries)).select("transaction_id")


def round_amount(book: DataFrame, min_amount: float = C.ROUND_MIN_AMOUNT) -> DataFrame:
    return book.filter(is_round(min_amount)).select("transaction_id")


# A rule is a function from book to flagged ids, or from nothing to a flag column.
TIMELINE_RULES: dict[str, Callable[..., DataFrame]] = {
    "structuring": structuring,
    "rapid_movement": rapid_movement,
}
ROW_RULES: dict[str, Callable[..., Column]] = {
    "high_risk_country": is_high_risk,
    "round_amount": is_round,
}
RULES = C.RULES


def apply_all(
    book: DataFrame,
    params: dict[str, dict] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """The book with one flag per rule, ``rules_fired``, ``rule_alert`` and ``rule_reasons``.

    Ids found by timeline rules are merged before they meet the book: one join.
    """
    params = params or {}
    book = with_clock(book)
    hot = _hot(book, hot)
    hits = None
    for name, rule in TIMELINE_RULES.items():
        ids = rule(book, hot=hot, **params.get(name, {})).withColumn("_rule", F.lit(name))
        hits = ids if hits is None else hits.union(ids)
    found = hits.groupBy("transaction_id").agg(
        *[F.max(F.col("_rule") == name).alias(name) for name in TIMELINE_RULES]
    )
    flagged = book.join(found, "transaction_id", "left").withColumns(
        {
            **{name: F.coalesce(name, F.lit(False)) for name in TIMELINE_RULES},
            **{name: rule(**params.get(name, {})) for name, rule in ROW_RULES.items()},
        }
    )
    fired = sum((F.col(r).cast("int") for r in RULES[1:]), F.col(RULES[0]).cast("int"))
    return flagged.withColumns(
        {
            "rules_fired": fired,
            "rule_alert": fired > 0,
            "rule_reasons": reason_text({r: F.col(r) for r in RULES}),
        }
    )


def fired_long(flagged: DataFrame) -> DataFrame:
    """One row per (transaction, rule that fired)."""
    names = F.array(*[F.when(F.col(r), F.lit(r)) for r in RULES])
    return flagged.select(
        "transaction_id", F.explode(F.array_compact(names)).alias("rule"), "rules_fired"
    )

"""The account graph: collection accounts and two-hop chains."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numbers import cents, in_band, ratio
from ..plans import count_in_ranges, together
from .evaluation import LABEL
from .rules import with_clock


def funnel_accounts(
    book: DataFrame,
    threshold: float = C.REPORTING_THRESHOLD,
    band_low: float = C.BAND_LOW,
    min_senders: int = C.FUNNEL_MIN_SENDERS,
) -> DataFrame:
    """Inbound profile of every account; funnels take near-threshold sums from many senders.

    Grouping by (receiver, sender) first makes distinct senders a plain count and keeps a
    busy receiver spread over its senders until only small groups are left.
    """
    near = in_band(F.col("amount"), threshold, band_low)
    money = cents(F.col("amount"))
    pairs = (
        book.filter("receiver_account IS NOT NULL")
        .groupBy("receiver_account", "sender_account")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(money).alias("total"),
            F.count_if(near).alias("near_n"),
            F.sum(F.when(near, money).otherwise(0)).alias("near_total"),
        )
    )
    known = F.col("sender_account").isNotNull()
    accounts = pairs.groupBy("receiver_account").agg(
        F.sum("n").alias("inbound_payments"),
        (F.sum("total") / 100).alias("inbound_total"),
        F.count_if(known).alias("distinct_senders"),
        F.sum("near_n").alias("near_threshold_payments"),
        (F.sum("near_total") / 100).alias("near_threshold_total"),
        F.count_if(known & (F.col("near_n") > 0)).alias("near_threshold_senders"),
    )
    return accounts.withColumns(
        {
            "share_near_threshold": ratio(F.col("near_threshold_total"), F.col("inbound_total")),
            "is_funnel": F.col("near_threshold_senders") >= min_senders,
        }
    )


def chains(
    book: DataFrame,
    min_amount: float = C.PASS_MIN_AMOUNT,
    window_hours: float = C.CHAIN_HOURS,
    tolerance: str = C.CHAIN_TOLERANCE,
) -> DataFrame:
    """Payments passed on soon and for a similar amount, one row per pair.

    :func:`with_partners` answers most questions without the pairs. The join key holds the account, a time slot and an amount slot; an incoming payment
    looks into the at most four slots its partners can be in. Candidate pairs then stay
    within a small factor of the pairs that qualify, also for an account with a large
    part of all payments.
    """
    width = round(window_hours * C.HOUR)
    tol = Decimal(tolerance)
    top, bottom = tol.as_integer_ratio()
    step = math.log((1 + float(tol)) / (1 - float(tol))) + 1e-6

    def size_slot(money, factor: float = 1.0, nudge: float = 0.0):
        return F.floor((F.log(F.greatest(money, F.lit(1)) * factor) + nudge) / step)

    big = (
        with_clock(book)
        .filter((F.col("amount") >= min_amount) & F.col("us").isNotNull())
        .withColumn("cents", cents(F.col("amount")))
    )
    incoming = big.select(
        F.col("transaction_id").alias("hop_in"),
        F.col("sender_account").alias("origin"),
        F.col("receiver_account").alias("intermediary"),
        F.col("cents").alias("cents_in"),
        F.col("us").alias("us_in"),
        F.explode(
            F.array(F.floor(F.col("us") / width), F.floor(F.col("us") / width) + 1)
        ).alias("slot"),
    ).withColumn(
        "size",
        F.explode(
            F.sequence(
                size_slot(F.col("cents_in"), 1 - float(tol), -1e-7),
                size_slot(F.col("cents_in"), 1 + float(tol), 1e-7),
            )
        ),
    )
    outgoing = big.select(
        F.col("transaction_id").alias("hop_out"),
        F.col("sender_account").alias("via"),
        F.col("receiver_account").alias("destination"),
        F.col("cents").alias("cents_out"),
        F.col("us").alias("us_out"),
        F.floor(F.col("us") / width).alias("slot_out"),
        size_slot(F.col("cents")).alias("size_out"),
    )
    match = (
        (F.col("intermediary") == F.col("via"))
        & (F.col("slot") == F.col("slot_out"))
        & (F.col("size") == F.col("size_out"))
        & (F.col("us_out") > F.col("us_in"))
        & (F.col("us_out") <= F.col("us_in") + width)
        & (F.abs(F.col("cents_out") - F.col("cents_in")) * bottom <= F.col("cents_in") * top)
    )
    return incoming.join(outgoing, match).select(
        "hop_in",
        "hop_out",
        "origin",
        "intermediary",
        "destination",
        (F.col("cents_in") / 100).alias("amount_in"),
        (F.col("cents_out") / 100).alias("amount_out"),
        F.round((F.col("us_out") - F.col("us_in")) / C.HOUR, 1).alias("hours_held"),
    )


def with_partners(
    book: DataFrame,
    min_amount: float = C.PASS_MIN_AMOUNT,
    window_hours: float = C.CHAIN_HOURS,
    tolerance: str = C.CHAIN_TOLERANCE,
) -> DataFrame:
    """The book, each payment with its partners in two-hop chains; no pair is listed.

    ``passed_on`` payments leave its receiver soon after and for a similar amount, the earliest is
    ``next_hop``; ``fed_by`` payments reached its sender shortly before, the latest is
    ``previous_hop`` (ties to the smallest id). ``in_chain`` says whether there are any. Summed over
    the book, either number is that of the rows of :func:`chains`.
    """
    width = round(window_hours * C.HOUR)
    top, bottom = Decimal(tolerance).as_integer_ratio()
    rows = with_clock(book).withColumn("_cents", cents(F.col("amount")))
    big = rows.filter(F.col("amount") >= min_amount)

    up, down = bottom + top, bottom - top
    least = lambda a, b: F.expr(f"(_cents * {a} + {b} - 1) DIV {b}")
    most = lambda a, b: F.expr(f"(_cents * {a}) DIV {b}")
    # backwards in time, the last one is the first
    onward = ("receiver_account", "sender_account", F.col("us"), least(down, bottom), most(up, bottom))
    inward = ("sender_account", "receiver_account", -F.col("us"), least(bottom, up), most(bottom, down))

    def partners(asking: str, other: str, clock, lo, hi) -> DataFrame:
        asked = big.select(F.col(asking).alias("key"), clock.alias("us"), lo.alias("lo"), hi.alias("hi"))
        points = big.select(
            F.col(other).alias("key"),
            clock.alias("us"),
            F.col("_cents").alias("value"),
            F.col("transaction_id").alias("id"),
        )
        return count_in_ranges(asked, points, width)

    def attach(out: DataFrame, how: tuple, found: DataFrame, n: str, hop: str) -> DataFrame:
        account, _, clock, lo, hi = how
        own = out.withColumns({"_us": clock, "_lo": lo, "_hi": hi})
        met = found.select(
            F.col("key").alias("_key"),
            F.col("us").alias("_at"),
            F.col("lo").alias("_low"),
            F.col("hi").alias("_high"),
            F.col("met").alias(n),
            F.col("first.id").alias(hop),
        )
        on = (F.col(account) == F.col("_key")) & (F.col("_us") == F.col("_at")) & (F.col("amount") >= min_amount)
        on &= (F.col("_lo") == F.col("_low")) & (F.col("_hi") == F.col("_high"))
        joined = own.join(met, on, "left").drop("_key", "_at", "_low", "_high", "_us", "_lo", "_hi")
        return joined.withColumn(n, F.coalesce(n, F.lit(0).cast("bigint")))

    later, earlier = together(lambda: partners(*onward), lambda: partners(*inward))
    out = attach(rows, onward, later, "passed_on", "next_hop")
    out = attach(out, inward, earlier, "fed_by", "previous_hop")
    return out.drop("_cents").withColumn("in_chain", (F.col("passed_on") > 0) | (F.col("fed_by") > 0))


def chain_cases(partnered: DataFrame) -> DataFrame:
    """Hops, payments in them and known cases among those, of a labelled book with partners."""
    return partnered.agg(
        F.coalesce(F.sum("passed_on"), F.lit(0)).alias("chain_hops_found"),
        F.count_if("in_chain").alias("chain_transactions"),
        F.coalesce(F.sum(F.when(F.col("in_chain"), F.col(LABEL))), F.lit(0))
        .cast("bigint")
        .alias("known_cases_in_chains"),
    )


def summary(partnered: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row: funnels, chains and the transaction alerts that cover the same ground."""
    alerts = partnered.agg(F.coalesce(F.sum(LABEL), F.lit(0)).cast("bigint").alias("n"))
    inside = chain_cases(partnered).select(F.struct("*").alias("c"))
    return (
        funnel_recall(partnered, accounts)
        .withColumn("c", inside.scalar())
        .select("*", "c.*", alerts.scalar().alias("transaction_alerts_for_the_same_ground"))
        .drop("c")
    )


def funnel_recall(
    labelled: DataFrame, accounts: DataFrame, threshold: float = C.REPORTING_THRESHOLD
) -> DataFrame:
    """Share of the known structuring beneficiaries that are funnels."""
    case = (F.col(LABEL) == 1) & (F.col("amount") < threshold)
    known = labelled.filter(case).select("receiver_account").distinct()
    funnels = accounts.filter("is_funnel").select("receiver_account")
    caught = known.intersect(funnels)
    count = F.count(F.lit(1))
    return accounts.agg(
        count.alias("accounts_in_book"), F.count_if("is_funnel").alias("funnel_accounts_flagged")
    ).withColumns(
        {
            "structuring_beneficiary_accounts": known.agg(count.alias("n")).scalar(),
            "of_those_caught_as_funnels": caught.agg(count.alias("n")).scalar(),
        }
    ).withColumn(
        "funnel_recall",
        F.round(
            F.col("of_those_caught_as_funnels")
            / F.greatest(F.col("structuring_beneficiary_accounts"), F.lit(1)),
            4,
        ),
    )

"""Behavioural features from each account's past only.

A row's history ends strictly before it in (time, transaction id) order. Identifiers and
country risk are not features: the jurisdiction rule and the model should fail apart.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numbers import cents
from ..plans import HotKeys, find_hot, paired, running
from .rules import with_clock

# kinds of timeline rows; probes are PROBE, PROBE + 1, ...
OPENING, EVENT, FIRST_SEEN, PROBE = -1, 0, 1, 2
BEGINNING = -(2**60)  # before any payment, in microseconds

NUMERIC = (
    "log_amount",
    "amount_z_vs_account",
    "amount_vs_account_max",
    "hour",
    "is_night",
    "day_of_week",
    "is_weekend",
    "is_cross_border",
    "sender_velocity_24h",
    "sender_velocity_7d",
    "receiver_velocity_24h",
    "sender_txn_count",
    "sender_distinct_counterparties",
    "receiver_distinct_counterparties",
    "sender_account_age_days",
    "pct_of_threshold",
)
CATEGORICAL = ("transaction_type", "channel")
MAX_LEVELS = 500  # per category with a column of their own; all others share one
RARE = "<rare>"


def history(
    df: DataFrame,
    side: str,
    hot: HotKeys,
    velocities: dict[str, float] | None = None,
    count: str | None = None,
    distinct: str | None = None,
    amounts: bool = False,
    met_in: DataFrame | None = None,
    opened: DataFrame | None = None,
) -> DataFrame:
    """Add trailing columns of one side's account, all from one timeline and one shuffle.

    - ``velocities``: rows of the account in the hours before (the start included);
    - ``count``: rows of the account so far;
    - ``distinct``: counterparties met so far. Each enters the timeline once, right after
      its first payment, so the count is a running sum and no set is kept per account;
    - ``amounts``: number, sum, sum of squares and maximum of past amounts in pennies,
      exact integers so that their order of summation is immaterial.

    ``met_in`` names a cheaper source of the same payments to find first meetings in.
    ``opened`` (account, opened) adds each account's opening day as ``opened``: it is the
    first event of the timeline, which saves joining the book to the customers.

    A payment whose account is unknown has no past: it gets a timeline of its own, so such
    rows neither share a history nor meet in one task.
    """
    velocities = velocities or {}
    key, other = f"{side}_account", ("receiver" if side == "sender" else "sender") + "_account"
    money = cents(F.col("amount"))

    def row(kind: int, us: Column, phase: int, **values: Column) -> Column:
        fields = {
            "kind": F.lit(kind),
            "phase": F.lit(phase),
            "us": us,
            "one": F.lit(None).cast("bigint"),
            "cents": F.lit(None).cast("bigint"),
            "row": F.lit(None).cast(df.schema),
        }
        fields.update(values)
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    event = row(
        EVENT,
        F.col("us"),
        1,
        one=F.lit(1).cast("bigint"),
        cents=money,
        row=F.struct(*df.columns),
    )
    probes = [
        # before the events of its instant, so that it counts what left the window
        row(PROBE + i, F.col("us") - round(hours * C.HOUR), 0)
        for i, hours in enumerate(velocities.values())
    ]
    alone = F.concat(F.lit("\u0000"), F.xxhash64(*df.columns).cast("string"))
    timeline = df.select(
        F.coalesce(F.col(key), alone).alias("account"),
        F.col("transaction_id"),
        F.col("us").alias("us0"),
        (F.explode(F.array(event, *probes)) if probes else event).alias("e"),
    ).select("account", "transaction_id", "us0", "e.*")
    totals = {"seen": ("sum", "one")}
    if amounts:
        timeline = timeline.withColumn("squares", F.col("cents").cast("decimal(19,0)") * F.col("cents"))
        totals |= {
            "past_cents": ("sum", "cents"),
            "past_squares": ("sum", "squares"),
            "past_max": ("max", "cents"),
        }
    if distinct:
        firsts = (
            (df if met_in is None else met_in)
            .filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("account"), F.col(other).alias("_other"))
            .agg(F.min(F.struct("us", "transaction_id")).alias("first"))
            .select(
                "account",
                "first.us",
                "first.transaction_id",
                F.col("first.us").alias("us0"),
                F.lit(FIRST_SEEN).alias("kind"),
                F.lit(1).alias("phase"),
                F.lit(1).cast("bigint").alias("new"),
            )
        )
        timeline = timeline.unionByName(firsts, allowMissingColumns=True)
        totals["met"] = ("sum", "new")
    if opened is not None:
        openings = opened.select(
            "account",
            F.lit(BEGINNING).cast("bigint").alias("us"),
            F.lit(BEGINNING).cast("bigint").alias("us0"),
            F.lit("").alias("transaction_id"),
            F.lit(OPENING).alias("kind"),
            F.lit(0).alias("phase"),
            F.unix_date("opened").alias("opened_day"),
        )
        timeline = timeline.unionByName(openings, allowMissingColumns=True)
        totals["first_opened"] = ("min", "opened_day")
    read = running(
        timeline, ["account"], ["us", "phase", "transaction_id", "kind"], totals, hot, include_self=False
    )
    zero = F.lit(0).cast("bigint")
    seen = F.coalesce("seen", zero)
    if velocities:
        read = paired(
            read,
            ["account", "transaction_id", "us0"],
            {
                f"_left_{i}": F.when(F.col("kind") == PROBE + i, seen)
                for i in range(len(velocities))
            },
        )
    added = {name: seen - F.col(f"_left_{i}") for i, name in enumerate(velocities)}
    if count:
        added[count] = seen
    if distinct:
        added[distinct] = F.coalesce("met", zero)
    if opened is not None:
        added["opened"] = F.date_from_unix_date("first_opened")
    if amounts:
        added |= {
            "past_count": seen,
            "past_cents": F.col("past_cents"),
            "past_squares": F.col("past_squares"),
            "past_max": F.col("past_max"),
        }
    return read.filter(F.col("kind") == EVENT).select(
        "row.*", *[c.alias(name) for name, c in added.items()]
    )


def amount_z(min_history: int = C.MIN_HISTORY) -> Column:
    """Standard score against the account's past; 0 with thin or constant history."""
    n = F.col("past_count").cast("decimal(12,0)")
    total = F.col("past_cents").cast("decimal(19,0)")
    # n * sum(x^2) - sum(x)^2, exact, is n (n - 1) times the sample variance
    spread = (F.col("past_squares") * n - total * total).cast("double")
    count = F.col("past_count").cast("double")
    std = F.sqrt(F.try_divide(spread, count * (count - 1)))
    mean = F.try_divide(F.col("past_cents").cast("double"), count)
    score = F.try_divide(cents(F.col("amount")).cast("double") - mean, std)
    return F.coalesce(F.when(F.col("past_count") >= min_history, score), F.lit(0.0))


def amount_vs_max() -> Column:
    return F.coalesce(
        F.try_divide(cents(F.col("amount")).cast("double"), F.col("past_max").cast("double")),
        F.lit(1.0),
    )


def trailing_amounts(book: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """The book with the amount's standard score and its ratio to the past maximum."""
    df = with_clock(book)
    hot = find_hot(df) if hot is None else hot
    return (
        history(df, "sender", hot, amounts=True)
        .withColumns(
            {"amount_z_vs_account": amount_z(), "amount_vs_account_max": amount_vs_max()}
        )
        .drop("past_cents", "past_squares", "past_max")
    )


def opening_days(customers: DataFrame) -> DataFrame:
    return customers.select(
        F.col("account_id").alias("account"), F.col("account_open_date").alias("opened")
    ).filter("account IS NOT NULL AND opened IS NOT NULL")


def median_tenure(book: DataFrame, customers: DataFrame) -> DataFrame:
    """One row: the exact median account age over all payments of known accounts.

    Payments are counted per account and day before they meet the customers, and per age
    before the median, so neither step grows with a busy account.
    """
    per_day = (
        book.groupBy(F.col("sender_account").alias("account"), F.to_date("timestamp").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = opening_days(customers).groupBy("account").agg(F.min("opened").alias("opened"))
    return (
        per_day.join(first, "account")
        .groupBy(F.datediff("day", "opened").alias("days"))
        .agg(F.sum("n").alias("n"))
        .agg(F.expr("percentile(days, 0.5, n)").alias("median"))
    )


def tenure(median: DataFrame) -> Column:
    """Whole days since the account was opened; unknown accounts get the median."""
    days = F.datediff(F.to_date("timestamp"), F.col("opened")).cast("double")
    return F.coalesce(days, median.scalar())


def with_tenure(book: DataFrame, customers: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """The book with ``sender_account_age_days``."""
    df = with_clock(book)
    hot = find_hot(df) if hot is None else hot
    dated = history(df, "sender", hot, opened=opening_days(customers))
    return dated.withColumn(
        "sender_account_age_days", tenure(median_tenure(df, customers))
    ).drop("opened")


def frequent_levels(book: DataFrame, column: str, most: int = MAX_LEVELS) -> list[str]:
    """The ``most`` frequent levels (ties by name), sorted; ``RARE`` follows if there are others."""
    counts = book.select(column).filter(F.col(column).isNotNull()).groupBy(column).count()
    found = [r[0] for r in counts.orderBy(F.desc("count"), column).limit(most + 1).collect()]
    kept = sorted(name for name in found[:most] if name != RARE)
    return [*kept, RARE] if len(found) > len(kept) else kept


def observed_levels(book: DataFrame, most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Category levels in the book, to be frozen with a model."""
    return {column: frequent_levels(book, column, most) for column in CATEGORICAL}


def one_hot(levels: dict[str, list[str]]) -> dict[str, Column]:
    """One 0/1 column per level, none dropped; a level not listed gives zeros.

    Where ``RARE`` is listed, its column holds every other level, also those unseen so far.
    """

    def is_level(column: str, names: list[str], level: str) -> Column:
        value = F.col(column)
        if level != RARE:
            return value == level
        return ~value.isin([name for name in names if name != RARE])

    return {
        f"{column}_{level}": F.coalesce(is_level(column, names, level), F.lit(False)).cast("double")
        for column, names in levels.items()
        for level in names
    }


def build_features(
    book: DataFrame,
    customers: DataFrame,
    levels: dict[str, list[str]],
    hot: HotKeys | None = None,
    threshold: float = C.REPORTING_THRESHOLD,
    keep: tuple[str, ...] = (),
    names: Iterable[str] | None = None,
) -> DataFrame:
    """``transaction_id``, the columns in ``keep`` and one double column per feature.

    ``names`` are the features that a model reads, all if not given; rows on the timelines carry
    what these need and nothing else.
    """
    df = with_clock(book)
    hot = find_hot(df) if hot is None else hot
    encoded = one_hot(levels)
    wanted = {*NUMERIC, *encoded} if names is None else set(names)
    encoded = {name: column for name, column in encoded.items() if name in wanted}
    sources = {
        "timestamp": {"sender_account_age_days"},
        "hour": {"hour", "is_night"},
        "day_of_week": {"day_of_week", "is_weekend"},
        "is_cross_border": {"is_cross_border"},
        **{column: {name for name in encoded if name.startswith(f"{column}_")} for column in CATEGORICAL},
    }
    needed = {
        "transaction_id",
        "us",
        "sender_account",
        "receiver_account",
        "amount",
        *[column for column, readers in sources.items() if readers & wanted],
        *keep,
    }
    past = df = df.select(*[c for c in df.columns if c in needed])
    payments = df.select("transaction_id", "us", "sender_account", "receiver_account")
    of_sender = {
        "velocities": {n: h for n, h in (("sender_velocity_24h", 24), ("sender_velocity_7d", 24 * 7)) if n in wanted},
        "count": next((n for n in ("sender_txn_count",) if n in wanted), None),
        "distinct": next((n for n in ("sender_distinct_counterparties",) if n in wanted), None),
        "amounts": not wanted.isdisjoint({"amount_z_vs_account", "amount_vs_account_max"}),
        "opened": opening_days(customers) if "sender_account_age_days" in wanted else None,
    }
    if of_sender["opened"] is not None or any(v for k, v in of_sender.items() if k != "opened"):
        past = history(past, "sender", hot, met_in=payments, **of_sender)
    added = {}
    if of_sender["amounts"]:
        added |= {"amount_z_vs_account": amount_z(), "amount_vs_account_max": amount_vs_max()}
    if of_sender["opened"] is not None:
        added["sender_account_age_days"] = tenure(median_tenure(df, customers))
    past = past.withColumns(added).drop("past_count", "past_cents", "past_squares", "past_max", "opened")
    of_receiver = {
        "velocities": {"receiver_velocity_24h": 24} if "receiver_velocity_24h" in wanted else {},
        "distinct": next((n for n in ("receiver_distinct_counterparties",) if n in wanted), None),
    }
    if any(of_receiver.values()):
        past = history(past, "receiver", hot, met_in=payments, **of_receiver)
    derived = {
        "log_amount": F.log1p("amount"),
        "is_night": F.col("hour").between(1, 5),
        "is_weekend": F.col("day_of_week") >= 5,
        "pct_of_threshold": F.col("amount") / threshold,
    }
    full = past.withColumns({**{n: c for n, c in derived.items() if n in wanted}, **encoded})
    return full.select(
        "transaction_id",
        *keep,
        *[F.col(c).cast("double").alias(c) for c in NUMERIC if c in wanted],
        *encoded,
    )


def feature_names(levels: dict[str, list[str]]) -> list[str]:
    return [*NUMERIC, *one_hot(levels)]

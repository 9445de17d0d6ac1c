"""What each alert's rule saw, rebuilt from the book.

Alerts are probes on the account timelines: counts and sums over ``[t - w, t + w]`` are
differences of running totals. A minimum or maximum over a range of width ``L`` is the
extreme of two running ones: the time axis is cut into blocks of width ``L``, the range
then covers the end of one block and the start of the next. No alert is ever paired with
its peers one by one, so a busy account costs a sort and not a square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numbers import cents, in_band
from ..functions.text import pounds, whole
from ..plans import HotKeys, find_hot, running
from .evaluation import headline
from .rules import by_side, with_clock

EVENT, LO, MID, HI = 0, 1, 2, 3
BEFORE, AT, AFTER = 0, 1, 2  # order of rows at one instant

# --- fixed values: the sentences shown to analysts -------------------------------
BURST_TEXT = (
    "{n} payments {shape} {account} within {days} days ({detail}), each between {low} and {high} "
    "all sitting just under the {threshold} reporting threshold."
)
CREDIT_TEXT = (
    "{credit} arrived from {payer}, and {amount} ({share}% of it) left for {receiver} {gap} hours "
    "later. The account held the funds, it did not use them."
)
DEBIT_TEXT = (
    "{amount} landed in {receiver}, and {out} left again across {n} payment(s) within {gap} hours, "
    "which is {share}% of what arrived."
)
NEITHER_TEXT = "Funds moved in and out of the account inside the 24-hour window."
COUNTRY_TEXT = (
    "{sender} → {receiver}: one leg touches a high-risk jurisdiction. On its own this screen is "
    "the noisiest rule in the system, so it only escalates when the transaction is also "
    "behaviourally unusual."
)
ROUND_TEXT = (
    "{amount} exactly, a whole-pound amount at size. Organic retail payments rarely land on a "
    "round number."
)
SCORE_TEXT = (
    "No rule fired. The model placed this in the top 0.1% of the book on amount shape, timing, "
    "velocity and counterparty spread: the channel that exists for typologies nobody wrote a rule "
    "for."
)


def filled_in(template: str, **values: Column) -> Column:
    """Concatenate a template's text with columns for its ``{names}``."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(text), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _probes(alerts: DataFrame, offsets: dict[int, tuple[int, int]], keys: list[str]) -> DataFrame:
    """One timeline row per alert and ``{kind: (shift, place at its instant)}``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(phase).alias("phase"),
                (F.col("us") + shift).alias("us"),
            )
            for kind, (shift, phase) in offsets.items()
        ]
    )
    return alerts.select(
        *keys, "transaction_id", F.col("us").alias("us0"), F.explode(rows).alias("p")
    ).select(*keys, "transaction_id", "us0", "p.*")


def _events(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    return df.select(
        *keys,
        "transaction_id",
        F.col("us").alias("us0"),
        F.lit(EVENT).alias("kind"),
        F.lit(AT).alias("phase"),
        "us",
        *[c.alias(n) for n, c in values.items()],
    )


_CLOCK = ["us", "phase", "transaction_id", "kind"]
_BACK = ["us", "back_phase", "transaction_id", "kind"]


def _ranges(
    timeline: DataFrame, keys: list[str], width: int, extremes: dict[str, tuple[str, str]], hot: HotKeys
) -> DataFrame:
    """Extremes from a block's start (``head_*``) and to its end (``tail_*``).

    Read at ``x`` (tail) and ``x + width`` (head) they cover ``[x, x + width]``.
    """
    blocked = timeline.withColumns(
        {"block": F.floor(F.col("us") / width), "back_phase": -F.col("phase")}
    )
    heads = {f"head_{n}": spec for n, spec in extremes.items()}
    tails = {f"tail_{n}": spec for n, spec in extremes.items()}
    out = running(blocked, [*keys, "block"], _CLOCK, heads, hot)
    return running(out, [*keys, "block"], _BACK, tails, hot, backwards=True)


def _sender_presence(near: DataFrame, width: int) -> DataFrame:
    """When each sender of a receiver is within ``width`` of some payment of theirs.

    The union of a sender's intervals around payments, as +1 and -1 marks; the running
    sum of the marks is the number of distinct senders around any instant. Payments are
    first reduced to their extremes per slot, so a long series is a short list.
    """
    slots = near.groupBy(
        F.col("receiver_account").alias("account"),
        "sender_account",
        F.floor(F.col("us") / width).alias("slot"),
    ).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    of_sender = Window.partitionBy("account", "sender_account").orderBy("slot")
    gap_before = F.col("lo") - F.lag("hi").over(of_sender)
    islands = (
        slots.withColumn("fresh", F.coalesce(gap_before > 2 * width, F.lit(True)).cast("int"))
        .withColumn(
            "island",
            F.sum("fresh").over(of_sender.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .groupBy("account", "sender_account", "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    marks = F.array(
        F.struct((F.col("lo") - width).alias("us"), F.lit(1).alias("present")),
        F.struct((F.col("hi") + width + 1).alias("us"), F.lit(-1).alias("present")),
    )
    return islands.select("account", F.explode(marks).alias("m")).select(
        F.lit("receiver").alias("side"),
        "account",
        F.lit("").alias("transaction_id"),
        F.col("m.us").alias("us0"),
        F.lit(EVENT).alias("kind"),
        F.lit(BEFORE).alias("phase"),
        "m.us",
        F.col("m.present").cast("bigint").alias("present"),
    )


def structuring_evidence(
    alerts: DataFrame,
    book: DataFrame,
    threshold: float = C.REPORTING_THRESHOLD,
    band_low: float = C.BAND_LOW,
    window_days: int = C.BURST_DAYS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """The in-band payments around each alert, on the side where there are more."""
    width = window_days * C.DAY
    near = with_clock(book).filter(in_band(F.col("amount"), threshold, band_low))
    near = near.withColumn("cents", cents(F.col("amount")))
    hot = find_hot(near) if hot is None else hot
    keys = ["side", "account"]
    asked = by_side(with_clock(alerts))
    events = _events(
        by_side(near, ("transaction_id", "us", "cents")),
        keys,
        one=F.lit(1).cast("bigint"),
        cents=F.col("cents"),
    )
    probes = _probes(asked, {LO: (-width, BEFORE), MID: (0, AFTER), HI: (width, AFTER)}, keys)
    timeline = (
        events.unionByName(probes, allowMissingColumns=True)
        .unionByName(_sender_presence(near, width), allowMissingColumns=True)
    )
    counted = running(
        timeline, keys, _CLOCK, {"seen": ("sum", "one"), "senders": ("sum", "present")}, hot
    )
    ranged = _ranges(
        counted, keys, 2 * width, {"low": ("min", "cents"), "high": ("max", "cents")}, hot
    )

    def at(kind: int, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    zero = F.lit(0).cast("bigint")
    per_side = (
        ranged.filter(F.col("kind") != EVENT)
        .groupBy(*keys, "transaction_id", "us0")
        .agg(
            (F.coalesce(at(HI, "seen"), zero) - F.coalesce(at(LO, "seen"), zero)).alias("n"),
            F.when(F.col("side") == "sender", F.lit(1).cast("bigint"))
            .otherwise(F.coalesce(at(MID, "senders"), zero))
            .alias("senders"),
            F.least(at(LO, "tail_low"), at(HI, "head_low")).alias("low"),
            F.greatest(at(LO, "tail_high"), at(HI, "head_high")).alias("high"),
        )
    )
    best = F.max(
        F.struct(
            "n",
            (F.col("side") == "receiver").cast("int").alias("preferred"),  # settles a tie
            "account",
            "senders",
            "low",
            "high",
        )
    )
    into = F.col("b.preferred") == 1
    found = per_side.groupBy("transaction_id").agg(best.alias("b")).select(
        "transaction_id",
        F.when(into, "into").otherwise("out of").alias("shape"),
        "b.account",
        F.col("b.n").alias("payments"),
        F.col("b.senders").alias("senders"),
        (F.col("b.low") / 100).alias("low"),
        (F.col("b.high") / 100).alias("high"),
    )
    several = (F.col("shape") == "into") & (F.col("senders") > 1)
    return found.withColumn(
        "evidence",
        filled_in(
            BURST_TEXT,
            n=F.col("payments"),
            shape=F.col("shape"),
            account=F.col("account"),
            days=F.lit(window_days),
            detail=F.when(
                several, F.concat(F.col("senders").cast("string"), F.lit(" different senders"))
            ).otherwise("one sender"),
            low=pounds(F.col("low")),
            high=pounds(F.col("high")),
            threshold=pounds(F.lit(threshold)),
        ),
    )


def credits_before(
    asked: DataFrame,
    book: DataFrame,
    window_hours: float = C.PASS_HOURS,
    min_amount: float = C.PASS_MIN_AMOUNT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """For each asked payment: the largest and the latest credit its sender got in
    ``[t - window, t]``. Equal amounts are settled by time, then id. Payments whose
    sender got none are left out."""
    width = round(window_hours * C.HOUR)
    book = with_clock(book)
    hot = find_hot(book) if hot is None else hot
    credit = F.struct(
        cents(F.col("amount")).alias("cents"),
        F.col("us").alias("at"),
        F.col("transaction_id").alias("id"),
        F.col("sender_account").alias("payer"),
    )
    events = _events(
        book.filter((F.col("amount") >= min_amount) & F.col("receiver_account").isNotNull())
        .withColumn("account", F.col("receiver_account")),
        ["account"],
        credit=credit,
        at=F.col("us"),
    )
    probes = _probes(
        with_clock(asked).withColumn("account", F.col("sender_account")),
        {LO: (-width, BEFORE), HI: (0, AFTER)},
        ["account"],
    )
    timeline = events.unionByName(probes, allowMissingColumns=True)
    timeline = running(timeline, ["account"], _CLOCK, {"latest": ("max", "at")}, hot)
    ranged = _ranges(timeline, ["account"], width, {"credit": ("max", "credit")}, hot)
    lo, hi = F.col("kind") == LO, F.col("kind") == HI
    return (
        ranged.filter(F.col("kind") != EVENT)
        .groupBy("account", "transaction_id", "us0")
        .agg(
            F.max(F.when(lo, F.col("tail_credit"))).alias("tail"),
            F.max(F.when(hi, F.col("head_credit"))).alias("head"),
            F.max(F.when(hi, F.col("latest"))).alias("latest"),
        )
        .select(
            "transaction_id",
            "us0",
            F.greatest("tail", "head").alias("largest"),
            F.when(F.col("latest") >= F.col("us0") - width, F.col("latest")).alias("latest_us"),
        )
        .filter("largest IS NOT NULL")
    )


def debits_after(
    asked: DataFrame,
    book: DataFrame,
    window_hours: float = C.PASS_HOURS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """For each asked payment: what its receiver paid out in ``(t, t + window]``."""
    width = round(window_hours * C.HOUR)
    book = with_clock(book)
    hot = find_hot(book) if hot is None else hot
    events = _events(
        book.filter("sender_account IS NOT NULL").withColumn("account", F.col("sender_account")),
        ["account"],
        one=F.lit(1).cast("bigint"),
        cents=cents(F.col("amount")),
        at=F.col("us"),
    )
    probes = _probes(
        with_clock(asked).withColumn("account", F.col("receiver_account")),
        {LO: (0, AFTER), HI: (width, AFTER)},
        ["account"],
    )
    read = running(
        events.unionByName(probes, allowMissingColumns=True),
        ["account"],
        _CLOCK,
        {"seen": ("sum", "one"), "paid": ("sum", "cents"), "last": ("max", "at")},
        hot,
    )

    def at(kind: int, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    return (
        read.filter(F.col("kind") != EVENT)
        .groupBy("account", "transaction_id", "us0")
        .agg(
            (at(HI, "seen") - at(LO, "seen")).alias("debits"),
            (at(HI, "paid") - at(LO, "paid")).alias("debit_cents"),
            at(HI, "last").alias("last_debit_us"),
        )
        .filter("debits > 0")
        .drop("account")
    )


def rapid_evidence(
    alerts: DataFrame,
    book: DataFrame,
    window_hours: float = C.PASS_HOURS,
    min_amount: float = C.PASS_MIN_AMOUNT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """The other leg of each pass-through: the credit it came from, else the debits after."""
    book = with_clock(book)
    hot = find_hot(book) if hot is None else hot
    asked = with_clock(alerts).select(
        "transaction_id", "us", "sender_account", "receiver_account", "amount"
    )
    came = credits_before(asked, book, window_hours, min_amount, hot).drop("us0", "latest_us")
    left = debits_after(asked, book, window_hours, hot).drop("us0")
    full = asked.join(came, "transaction_id", "left").join(left, "transaction_id", "left")
    amount = F.col("amount")
    out = F.col("debit_cents") / 100
    found = full.select(
        "transaction_id",
        "sender_account",
        "receiver_account",
        "amount",
        F.when(F.col("largest").isNotNull(), "credit")
        .when(F.col("debits").isNotNull(), "debits")
        .otherwise("none")
        .alias("leg"),
        F.col("largest.payer").alias("payer"),
        (F.col("largest.cents") / 100).alias("credit_amount"),
        ((F.col("us") - F.col("largest.at")) / C.HOUR).alias("credit_gap_hours"),
        "debits",
        out.alias("debit_total"),
        ((F.col("last_debit_us") - F.col("us")) / C.HOUR).alias("debit_gap_hours"),
    )
    return found.withColumn(
        "evidence",
        F.when(
            F.col("leg") == "credit",
            filled_in(
                CREDIT_TEXT,
                credit=pounds(F.col("credit_amount")),
                payer=F.col("payer"),
                amount=pounds(amount),
                share=whole(F.try_divide(amount, F.col("credit_amount")) * 100),
                receiver=F.col("receiver_account"),
                gap=whole(F.col("credit_gap_hours")),
            ),
        )
        .when(
            F.col("leg") == "debits",
            filled_in(
                DEBIT_TEXT,
                amount=pounds(amount),
                receiver=F.col("receiver_account"),
                out=pounds(F.col("debit_total")),
                n=F.col("debits"),
                gap=whole(F.col("debit_gap_hours")),
                share=whole(F.try_divide(F.col("debit_total"), amount) * 100),
            ),
        )
        .otherwise(NEITHER_TEXT),
    )


def case_payload(
    cases: DataFrame,
    book: DataFrame,
    threshold: float = C.REPORTING_THRESHOLD,
    band_low: float = C.BAND_LOW,
    hot: HotKeys | None = None,
) -> DataFrame:
    """One nested record per numbered case, reasons and evidence as arrays, no source id.

    Records stay rows (one JSON object each when written); they are never gathered into
    a single document.
    """
    reasons = F.split("reason", ", ")
    cases = with_clock(cases).withColumn("reasons", reasons)
    book = with_clock(book)
    hot = find_hot(book) if hot is None else hot
    burst = structuring_evidence(
        cases.filter(F.array_contains("reasons", "structuring")), book, threshold, band_low, hot=hot
    ).select("transaction_id", F.col("evidence").alias("burst_text"))
    moved = rapid_evidence(
        cases.filter(F.array_contains("reasons", "rapid_movement")), book, hot=hot
    ).select("transaction_id", F.col("evidence").alias("moved_text"))
    full = cases.join(burst, "transaction_id", "left").join(moved, "transaction_id", "left")

    def given(reason: str, text: Column) -> Column:
        return F.when(F.array_contains("reasons", reason), text)

    evidence = F.array_compact(
        F.array(
            F.col("burst_text"),
            F.col("moved_text"),
            given(
                "high_risk_country",
                filled_in(
                    COUNTRY_TEXT,
                    sender=F.coalesce("sender_country", F.lit("?")),
                    receiver=F.coalesce("receiver_country", F.lit("?")),
                ),
            ),
            given("round_amount", filled_in(ROUND_TEXT, amount=pounds(F.col("amount")))),
            F.when(F.col("reason") == "anomaly score only", SCORE_TEXT),
        )
    )
    return full.select(
        F.col("alert_ref").alias("id"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("ts"),
        F.col("sender_account").alias("sender"),
        F.col("receiver_account").alias("receiver"),
        F.round("amount", 2).alias("amount"),
        F.col("sender_country").alias("from"),
        F.col("receiver_country").alias("to"),
        F.col("transaction_type").alias("type"),
        "channel",
        "reasons",
        F.col("escalation_channel").alias("channel_label"),
        F.round(F.col("anomaly_pct") * 100, 1).alias("score"),
        "priority",
        evidence.alias("evidence"),
    )


def rule_summary(metrics: DataFrame, contribution: DataFrame) -> DataFrame:
    """The payload's short table of rules (one row per rule)."""
    return metrics.join(contribution.select("rule", "cases_no_other_rule_found"), "rule").select(
        F.col("rule").alias("name"),
        "alerts",
        F.col("true_positives").alias("caught"),
        "precision",
        F.col("cases_no_other_rule_found").alias("unique"),
    )




def payload_pages(records: DataFrame, page: int = 500) -> DataFrame:
    """Cases in the queue's order, ``page`` to an array; a page is all that one task holds."""
    place = F.substring("id", len("ALERT-") + 1, 20).cast("bigint")
    case = F.struct(*records.columns)
    return (
        records.select(place.alias("place"), case.alias("case"))
        .groupBy(F.expr(f"(place - 1) div {page}").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "case"))).alias("listed"))
        .select("page", F.col("listed.case").alias("cases"))
    )


def payload_document(
    records: DataFrame,
    strategies: DataFrame,
    rules_table: DataFrame,
    dataset: DataFrame,
    page: int = 500,
) -> DataFrame:
    """Headline, strategies, book, table of rules and cases: one document per row when written.

    Page 0 is the whole payload of a queue of up to ``page`` cases. A longer queue goes on in
    further pages, which hold cases alone. Without cases there is page 0 with none.
    """
    spark = records.sparkSession

    def only(table: DataFrame) -> Column:
        return table.agg(F.first(F.struct(*table.columns))).scalar()

    def strategy(name: str) -> Column:
        return only(strategies.filter(F.col("strategy") == name).drop("strategy"))

    head = spark.range(1).select(
        F.lit(0).cast("bigint").alias("page"),
        only(headline(strategies, "any_rule", "combined_final")).alias("headline"),
        strategy("any_rule").alias("baseline"),
        strategy("combined_final").alias("combined"),
        strategy("ml_alone_same_budget").alias("ml_alone"),
        only(dataset).alias("dataset"),
        rules_table.agg(
            F.array_sort(F.collect_list(F.struct(*rules_table.columns)))
        ).scalar().alias("rules"),
    )
    document = head.join(payload_pages(records, page), "page", "full")
    none = F.array().cast(document.schema["cases"].dataType)
    return document.withColumn("cases", F.coalesce("cases", none))

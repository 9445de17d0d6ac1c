"""Alert evidence and payload."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, evaluation, evidence, rules
from ..operators.evaluation import Ranking
from .evaluation_queries import CASES_SQL
from .inputs import PARAMS, book, labelled, scored
from .registry import ORACLE, query
from .tables_sql import BOOK, FLAGGED, SCORED, rapid_sql, structuring_sql, with_tables

_NEAR = "amount >= 10000 * 0.60 AND amount < 10000"
_WEEK, _DAY = 604800000000, 86400000000

BURST = f"""
near AS (SELECT * FROM book WHERE {_NEAR}),
alerts AS (SELECT * FROM book SEMI JOIN structuring USING (transaction_id)),
into_side AS (
  SELECT a.transaction_id, a.receiver_account AS account, count(*) AS n,
         count(DISTINCT p.sender_account) AS senders, min(p.amount) AS low, max(p.amount) AS high
  FROM alerts a JOIN near p ON p.receiver_account = a.receiver_account
   AND p.us BETWEEN a.us - {_WEEK} AND a.us + {_WEEK} GROUP BY 1, 2),
out_side AS (
  SELECT a.transaction_id, a.sender_account AS account, count(*) AS n,
         count(DISTINCT p.sender_account) AS senders, min(p.amount) AS low, max(p.amount) AS high
  FROM alerts a JOIN near p ON p.sender_account = a.sender_account
   AND p.us BETWEEN a.us - {_WEEK} AND a.us + {_WEEK} GROUP BY 1, 2),
burst AS (
  SELECT transaction_id, CASE WHEN i.n >= o.n THEN 'into' ELSE 'out of' END AS shape,
         CASE WHEN i.n >= o.n THEN i.account ELSE o.account END AS account,
         CASE WHEN i.n >= o.n THEN i.n ELSE o.n END AS payments,
         CASE WHEN i.n >= o.n THEN i.senders ELSE o.senders END AS senders,
         CASE WHEN i.n >= o.n THEN i.low ELSE o.low END AS low,
         CASE WHEN i.n >= o.n THEN i.high ELSE o.high END AS high
  FROM into_side i JOIN out_side o USING (transaction_id))"""


BURST_TEXT_SQL = """payments || ' payments ' || shape || ' ' || account || ' within 7 days ('
  || CASE WHEN shape = 'into' AND senders > 1 THEN senders || ' different senders' ELSE 'one sender' END
  || '), each between £' || format('{:,.0f}', low) || ' and £' || format('{:,.0f}', high)
  || ' all sitting just under the £10,000 reporting threshold.'"""


@query(
    "structuring_evidence",
    with_tables(
        f"{BOOK}, {structuring_sql()}, {BURST}",
        f"SELECT *, {BURST_TEXT_SQL} AS evidence FROM burst",
    ),
)
def structuring_evidence(spark, sf_dir):
    payments = book(spark, sf_dir)
    ids = rules.structuring(payments, **PARAMS["structuring"])
    alerts = payments.join(ids, "transaction_id", "left_semi")
    return evidence.structuring_evidence(alerts, payments, band_low=0.60)


LEGS = f"""
alerts AS (SELECT * FROM book SEMI JOIN rapid USING (transaction_id)),
came AS (
  SELECT a.transaction_id, arg_max(struct_pack(cents := c.cents, at_us := c.us, payer := c.sender_account),
           struct_pack(cents := c.cents, at_us := c.us, id := c.transaction_id)) AS best
  FROM alerts a JOIN book c ON c.receiver_account = a.sender_account AND c.amount >= 1000
   AND c.us BETWEEN a.us - {_DAY} AND a.us GROUP BY 1),
went AS (
  SELECT a.transaction_id, count(*) AS debits, sum(d.cents) / 100.0 AS debit_total, max(d.us) AS last_us
  FROM alerts a JOIN book d ON d.sender_account = a.receiver_account
   AND d.us > a.us AND d.us <= a.us + {_DAY} GROUP BY 1),
legs AS (
  SELECT transaction_id, sender_account, receiver_account, amount,
         CASE WHEN best IS NOT NULL THEN 'credit' WHEN debits IS NOT NULL THEN 'debits' ELSE 'none' END AS leg,
         best.payer AS payer, best.cents / 100.0 AS credit_amount,
         (us - best.at_us) / 3600000000.0 AS credit_gap_hours, debits, debit_total,
         (last_us - us) / 3600000000.0 AS debit_gap_hours
  FROM alerts LEFT JOIN came USING (transaction_id) LEFT JOIN went USING (transaction_id))"""


LEGS_TEXT_SQL = """CASE leg WHEN 'credit' THEN '£' || format('{:,.0f}', credit_amount) || ' arrived from '
    || payer || ', and £' || format('{:,.0f}', amount) || ' ('
    || CAST(CAST(round_even(amount / credit_amount * 100, 0) AS BIGINT) AS VARCHAR) || '% of it) left for '
    || receiver_account || ' ' || CAST(CAST(round_even(credit_gap_hours, 0) AS BIGINT) AS VARCHAR)
    || ' hours later. The account held the funds, it did not use them.'
  WHEN 'debits' THEN '£' || format('{:,.0f}', amount) || ' landed in ' || receiver_account || ', and £'
    || format('{:,.0f}', debit_total) || ' left again across ' || debits || ' payment(s) within '
    || CAST(CAST(round_even(debit_gap_hours, 0) AS BIGINT) AS VARCHAR) || ' hours, which is '
    || CAST(CAST(round_even(debit_total / amount * 100, 0) AS BIGINT) AS VARCHAR) || '% of what arrived.'
  ELSE 'Funds moved in and out of the account inside the 24-hour window.' END"""


@query(
    "rapid_evidence",
    with_tables(
        f"{BOOK}, {rapid_sql()}, {LEGS}",
        f"""SELECT transaction_id, sender_account, receiver_account, amount, leg, payer, credit_amount,
  round(credit_gap_hours, 6) AS credit_gap_hours, debits, debit_total,
  round(debit_gap_hours, 6) AS debit_gap_hours, {LEGS_TEXT_SQL} AS evidence FROM legs""",
    ),
)
def rapid_evidence(spark, sf_dir):
    payments = book(spark, sf_dir)
    ids = rules.rapid_movement(payments, **PARAMS["rapid_movement"])
    alerts = payments.join(ids, "transaction_id", "left_semi")
    found = evidence.rapid_evidence(alerts, payments)
    return found.withColumns(
        {c: F.round(c, 6) for c in ("credit_gap_hours", "debit_gap_hours")}
    )


_PAYLOAD = f"""{SCORED}, {CASES_SQL}, {BURST.replace("alerts", "burst_alerts")},
{LEGS.replace("alerts", "leg_alerts")},
burst_said AS (SELECT transaction_id, {BURST_TEXT_SQL} AS burst_text FROM burst),
legs_said AS (SELECT transaction_id, {LEGS_TEXT_SQL} AS legs_text FROM legs)"""


@query(
    "alert_payload",
    with_tables(
        _PAYLOAD,
        """SELECT printf('ALERT-%04d', position) AS id, strftime(t, '%Y-%m-%d %H:%M') AS ts,
  sender_account AS sender, receiver_account AS receiver, round(amount, 2) AS amount,
  sender_country AS "from", receiver_country AS "to", transaction_type AS type, channel,
  replace(reason, ', ', '|') AS reasons, escalation_channel AS channel_label,
  round(anomaly_pct * 100, 1) AS score, priority,
  array_to_string(list_filter([
    CASE WHEN structuring THEN burst_text END, CASE WHEN rapid_movement THEN legs_text END,
    CASE WHEN high_risk_country THEN sender_country || ' → ' || receiver_country || ': one leg touches a '
      || 'high-risk jurisdiction. On its own this screen is the noisiest rule in the system, so it only '
      || 'escalates when the transaction is also behaviourally unusual.' END,
    CASE WHEN round_amount THEN '£' || format('{:,.0f}', amount) || ' exactly, a whole-pound amount at size. '
      || 'Organic retail payments rarely land on a round number.' END,
    CASE WHEN rule_reasons = '' THEN 'No rule fired. The model placed this in the top 0.1% of the book on '
      || 'amount shape, timing, velocity and counterparty spread: the channel that exists for typologies '
      || 'nobody wrote a rule for.' END], lambda x: x IS NOT NULL), '|') AS evidence
FROM queue LEFT JOIN burst_said USING (transaction_id) LEFT JOIN legs_said USING (transaction_id)""",
    ),
)
def alert_payload(spark, sf_dir):
    """The nested records with their two arrays joined to text, so that values compare."""
    rows = scored(spark, sf_dir)
    ranking = Ranking(rows)
    opened = cases.open_cases(evaluation.combined(rows, ranking), ranking)
    records = evidence.case_payload(cases.queue(opened), rows, band_low=0.60)
    return records.withColumns({c: F.array_join(c, "|") for c in ("reasons", "evidence")})


@query("alert_payload_nested", ORACLE["alert_payload"])
def alert_payload_nested(spark, sf_dir):
    """The records as they are written, one JSON object per case, read again field by field."""
    rows = scored(spark, sf_dir)
    ranking = Ranking(rows)
    opened = cases.open_cases(evaluation.combined(rows, ranking), ranking)
    records = evidence.case_payload(cases.queue(opened), rows, band_low=0.60)
    written = records.select(F.to_json(F.struct(*records.columns)).alias("record"))
    read = written.select(F.from_json("record", records.schema).alias("r")).select("r.*")
    return read.withColumns({c: F.array_join(c, "|") for c in ("reasons", "evidence")})


@query(
    "rule_summary",
    with_tables(
        FLAGGED,
        " UNION ALL ".join(
            f"""SELECT '{r}' AS name, count(*) AS alerts, count(*) FILTER (label = 1) AS caught,
  round(count(*) FILTER (label = 1) / CAST(count(*) AS DOUBLE), 4) AS precision,
  count(*) FILTER (label = 1 AND rules_fired = 1) AS "unique" FROM flagged WHERE {r}"""
            for r in rules.RULES
        ),
    ),
)
def rule_summary(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return evidence.rule_summary(evaluation.rule_metrics(rows), evaluation.rule_contribution(rows))

"""Account graph."""

from __future__ import annotations

from ..operators import network
from ..operators.evaluation import with_labels
from ..plans import stage
from ..sources import testbook
from .inputs import book
from .registry import query
from .tables_sql import BOOK, LABELS, with_tables

_FUNNELS = """
funnels AS (
  SELECT receiver_account, count(*) AS inbound_payments, sum(cents) / 100.0 AS inbound_total,
         count(DISTINCT sender_account) AS distinct_senders,
         count(*) FILTER (near) AS near_threshold_payments,
         coalesce(sum(cents) FILTER (near), 0) / 100.0 AS near_threshold_total,
         count(DISTINCT sender_account) FILTER (near) AS near_threshold_senders
  FROM (SELECT *, amount >= 7000 AND amount < 10000 AS near FROM book) GROUP BY 1)"""

_HOPS = """
hops AS (
  SELECT a.transaction_id AS hop_in, b.transaction_id AS hop_out, a.sender_account AS origin,
         a.receiver_account AS intermediary, b.receiver_account AS destination,
         a.cents / 100.0 AS amount_in, b.cents / 100.0 AS amount_out,
         round((b.us - a.us) / 3600000000.0, 1) AS hours_held
  FROM book a JOIN book b ON b.sender_account = a.receiver_account
   AND b.us > a.us AND b.us <= a.us + 86400000000
   AND abs(b.cents - a.cents) * 100 <= a.cents * 15
  WHERE a.amount >= 1000 AND b.amount >= 1000)"""


@query(
    "funnel_accounts",
    with_tables(
        f"{BOOK}, {_FUNNELS}",
        """SELECT *, round(near_threshold_total / inbound_total, 4) AS share_near_threshold,
  near_threshold_senders >= 3 AS is_funnel FROM funnels""",
    ),
)
def funnel_accounts(spark, sf_dir):
    return network.funnel_accounts(book(spark, sf_dir))


_SUMMARY = """
recall AS (
  SELECT *, round(of_those_caught_as_funnels / CAST(greatest(structuring_beneficiary_accounts, 1)
    AS DOUBLE), 4) AS funnel_recall
  FROM (SELECT count(*) AS accounts_in_book,
    count(*) FILTER (near_threshold_senders >= 3) AS funnel_accounts_flagged,
    (SELECT count(DISTINCT receiver_account) FROM labelled WHERE label = 1 AND amount < 10000)
      AS structuring_beneficiary_accounts,
    count(*) FILTER (near_threshold_senders >= 3 AND receiver_account IN (
      SELECT receiver_account FROM labelled WHERE label = 1 AND amount < 10000)) AS of_those_caught_as_funnels
    FROM funnels)),
inside AS (
  SELECT count(*) AS chain_transactions, CAST(sum(label) AS BIGINT) AS known_cases_in_chains,
    (SELECT count(*) FROM hops) AS chain_hops_found
  FROM labelled WHERE transaction_id IN (SELECT hop_in FROM hops UNION SELECT hop_out FROM hops))"""


@query(
    "network_summary",
    with_tables(
        f"{BOOK}, {LABELS}, labelled AS (SELECT * FROM book LEFT JOIN labels USING (transaction_id)), "
        f"{_FUNNELS}, {_HOPS}, {_SUMMARY}",
        """SELECT recall.*, inside.*, (SELECT CAST(sum(label) AS BIGINT) FROM labelled)
  AS transaction_alerts_for_the_same_ground FROM recall, inside""",
    ),
)
def network_summary(spark, sf_dir):
    payments = book(spark, sf_dir)
    known = with_labels(payments, testbook.labels(spark, sf_dir))
    paired = stage(network.with_partners(known), "partners")
    return network.summary(paired, network.funnel_accounts(payments))


@query("chain_hops", with_tables(f"{BOOK}, {_HOPS}", "SELECT * FROM hops"))
def chain_hops(spark, sf_dir):
    return network.chains(book(spark, sf_dir))


_LABELLED = f"{BOOK}, {LABELS}, labelled AS (SELECT * FROM book LEFT JOIN labels USING (transaction_id))"


@query(
    "funnel_recall",
    with_tables(
        f"{_LABELLED}, {_FUNNELS}, known AS (SELECT DISTINCT receiver_account FROM labelled "
        "WHERE label = 1 AND amount < 10000)",
        """SELECT *, round(of_those_caught_as_funnels / CAST(greatest(structuring_beneficiary_accounts, 1)
    AS DOUBLE), 4) AS funnel_recall
FROM (SELECT count(*) AS accounts_in_book,
  count(*) FILTER (near_threshold_senders >= 3) AS funnel_accounts_flagged,
  (SELECT count(*) FROM known) AS structuring_beneficiary_accounts,
  count(*) FILTER (near_threshold_senders >= 3 AND receiver_account IN (SELECT receiver_account FROM known))
    AS of_those_caught_as_funnels FROM funnels)""",
    ),
)
def funnel_recall(spark, sf_dir):
    payments = book(spark, sf_dir)
    known = with_labels(payments, testbook.labels(spark, sf_dir))
    return network.funnel_recall(known, network.funnel_accounts(payments))


@query(
    "chain_cases",
    with_tables(
        f"{_LABELLED}, {_HOPS}",
        """SELECT (SELECT count(*) FROM hops) AS chain_hops_found, count(*) AS chain_transactions,
  CAST(sum(label) AS BIGINT) AS known_cases_in_chains
FROM labelled WHERE transaction_id IN (SELECT hop_in FROM hops UNION SELECT hop_out FROM hops)""",
    ),
)
def chain_cases(spark, sf_dir):
    payments = book(spark, sf_dir)
    known = with_labels(payments, testbook.labels(spark, sf_dir))
    return network.chain_cases(network.with_partners(known))


@query(
    "chain_partners",
    with_tables(
        f"{BOOK}, {_HOPS}",
        """SELECT b.transaction_id, coalesce(o.n, 0) AS passed_on, o.hop AS next_hop,
  coalesce(i.n, 0) AS fed_by, i.hop AS previous_hop, (o.n IS NOT NULL OR i.n IS NOT NULL) AS in_chain
FROM book b
LEFT JOIN (SELECT hop_in, count(*) AS n, arg_min(hop_out, (p.us, hop_out)) AS hop
  FROM hops JOIN book p ON p.transaction_id = hop_out GROUP BY 1) o ON o.hop_in = b.transaction_id
LEFT JOIN (SELECT hop_out, count(*) AS n, arg_min(hop_in, (-p.us, hop_in)) AS hop
  FROM hops JOIN book p ON p.transaction_id = hop_in GROUP BY 1) i ON i.hop_out = b.transaction_id""",
    ),
)
def chain_partners(spark, sf_dir):
    return network.with_partners(book(spark, sf_dir)).select(
        "transaction_id", "passed_on", "next_hop", "fed_by", "previous_hop", "in_chain"
    )

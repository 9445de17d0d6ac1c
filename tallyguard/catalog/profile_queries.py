"""Profile of the raw feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling
from ..sources import testbook
from .inputs import book
from .registry import query
from .tables_sql import BOOK, CLEAN, CUSTOMERS, RAW, with_tables

_ALL = (
    "transaction_id, ts_text, sender_account, receiver_account, amount, currency, sender_country, "
    "receiver_country, transaction_type, channel"
)


@query(
    "profile_missing",
    with_tables(
        RAW,
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({v} IS NULL) AS missing FROM raw_book"
            for c, v in [
                (c, "ts_text" if c == "timestamp" else c)
                for c in (
                    "transaction_id timestamp sender_account receiver_account amount currency "
                    "sender_country receiver_country transaction_type channel"
                ).split()
            ]
        )
        + ") WHERE missing > 0",
    ),
)
def profile_missing(spark, sf_dir):
    return profiling.missing_values(testbook.raw_text(spark, sf_dir))


_VERSIONS = f"versions AS (SELECT {_ALL}, count(*) AS copies FROM raw_book GROUP BY ALL)"


@query(
    "profile_duplicates",
    with_tables(
        f"{RAW}, {_VERSIONS}",
        """SELECT count(*) AS duplicated_ids, CAST(sum(n) AS BIGINT) AS rows_covered,
  CAST(sum(identical) AS BIGINT) AS identical_rows
FROM (SELECT transaction_id, sum(copies) AS n, sum(CASE WHEN copies > 1 THEN copies ELSE 0 END) AS identical
      FROM versions GROUP BY 1 HAVING sum(copies) > 1)""",
    ),
)
def profile_duplicates(spark, sf_dir):
    return profiling.duplicate_summary(testbook.raw_text(spark, sf_dir))


@query(
    "profile_duplicate_rows",
    with_tables(
        RAW,
        f"""SELECT {_ALL} FROM raw_book WHERE transaction_id IN
  (SELECT transaction_id FROM raw_book GROUP BY 1 HAVING count(*) > 1)""",
    ),
)
def profile_duplicate_rows(spark, sf_dir):
    return profiling.duplicate_rows(testbook.raw_book(spark, sf_dir), None).withColumnRenamed(
        "timestamp", "ts_text"
    )


@query(
    "profile_duplicate_sample",
    with_tables(
        RAW,
        f"""SELECT {_ALL} FROM raw_book WHERE transaction_id IN
  (SELECT transaction_id FROM raw_book GROUP BY 1 HAVING count(*) > 1)
ORDER BY transaction_id, ts_text LIMIT 10""",
    ),
)
def profile_duplicate_sample(spark, sf_dir):
    return profiling.duplicate_rows(testbook.raw_book(spark, sf_dir), 10).withColumnRenamed(
        "timestamp", "ts_text"
    )


@query(
    "profile_duplicate_differences",
    with_tables(
        f"{RAW}, {_VERSIONS}",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS ids_that_differ FROM (SELECT transaction_id
  FROM versions GROUP BY 1 HAVING count(DISTINCT coalesce(CAST({v} AS VARCHAR), '-')) > 1)"""
            for c, v in [
                (c, "ts_text" if c == "timestamp" else c)
                for c in (
                    "timestamp sender_account receiver_account amount currency sender_country "
                    "receiver_country transaction_type channel"
                ).split()
            ]
        ),
    ),
)
def profile_duplicate_differences(spark, sf_dir):
    return profiling.duplicate_differences(testbook.raw_text(spark, sf_dir))


@query(
    "profile_negatives",
    with_tables(
        RAW,
        """SELECT count(*) AS n, min(amount) AS lowest, max(amount) AS highest
FROM raw_book WHERE amount < 0""",
    ),
)
def profile_negatives(spark, sf_dir):
    return profiling.negative_amounts(testbook.raw_text(spark, sf_dir))


@query(
    "profile_negative_types",
    with_tables(
        RAW,
        "SELECT transaction_type AS level, count(*) AS n FROM raw_book WHERE amount < 0 GROUP BY 1",
    ),
)
def profile_negative_types(spark, sf_dir):
    return profiling.negative_by_type(testbook.raw_text(spark, sf_dir))


@query(
    "profile_amounts",
    with_tables(
        RAW,
        """SELECT count(*) AS "count", round(avg(amount), 4) AS mean, round(stddev_samp(amount), 4) AS std,
  min(amount) AS "min", round(quantile_cont(amount, 0.5), 4) AS p50, round(quantile_cont(amount, 0.9), 4) AS p90,
  round(quantile_cont(amount, 0.99), 4) AS p99, round(quantile_cont(amount, 0.999), 4) AS p99_9,
  max(amount) AS "max", count(*) FILTER (amount > 50000) AS rows_above_large
FROM raw_book WHERE amount > 0""",
    ),
)
def profile_amounts(spark, sf_dir):
    out = profiling.amount_distribution(testbook.raw_text(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p50", "p90", "p99", "p99_9")})


@query(
    "profile_ts_formats",
    with_tables(
        RAW,
        """SELECT count(*) FILTER (NOT contains(ts_text, '/')) AS iso_rows,
  count(*) FILTER (contains(ts_text, '/')) AS slash_rows,
  min(CASE WHEN contains(ts_text, '/') THEN CAST(ts_text[1:2] AS INT) END) AS first_component_min,
  max(CASE WHEN contains(ts_text, '/') THEN CAST(ts_text[1:2] AS INT) END) AS first_component_max
FROM raw_book""",
    ),
)
def profile_ts_formats(spark, sf_dir):
    return profiling.timestamp_formats(testbook.raw_text(spark, sf_dir))


@query(
    "profile_countries",
    with_tables(
        RAW,
        """SELECT country AS level, count(*) AS n FROM (SELECT sender_country AS country FROM raw_book
  UNION ALL SELECT receiver_country FROM raw_book) GROUP BY 1""",
    ),
)
def profile_countries(spark, sf_dir):
    return profiling.country_spellings(testbook.raw_text(spark, sf_dir))


@query(
    "canonical_countries",
    with_tables(f"{RAW}, {CUSTOMERS}", "SELECT DISTINCT home_country FROM customers"),
)
def canonical_countries(spark, sf_dir):
    return profiling.canonical_countries(testbook.customers(spark, sf_dir))


@query(
    "portfolio_countries",
    with_tables(
        f"{RAW}, {CUSTOMERS}",
        "SELECT home_country AS level, count(*) AS n FROM customers GROUP BY 1",
    ),
)
def portfolio_countries(spark, sf_dir):
    return profiling.portfolio_countries(testbook.customers(spark, sf_dir))


@query(
    "profile_categories",
    with_tables(
        RAW,
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", {c} AS level, count(*) AS n FROM raw_book GROUP BY 2'
            for c in ("currency", "transaction_type", "channel")
        ),
    ),
)
def profile_categories(spark, sf_dir):
    return profiling.category_counts(testbook.raw_text(spark, sf_dir))


@query(
    "profile_id_prefix",
    with_tables(RAW, "SELECT transaction_id[1:4] AS level, count(*) AS n FROM raw_book GROUP BY 1"),
)
def profile_id_prefix(spark, sf_dir):
    return profiling.id_prefixes(testbook.raw_text(spark, sf_dir))


@query(
    "profile_accounts",
    with_tables(
        f"{RAW}, {CUSTOMERS}, sent AS (SELECT sender_account, count(*) AS n FROM raw_book GROUP BY 1)",
        """SELECT count(*) AS senders, median(n) AS sent_median, quantile_cont(n, 0.99) AS sent_p99,
  max(n) AS sent_max, (SELECT count(*) FROM (SELECT sender_account FROM raw_book UNION
   SELECT receiver_account FROM raw_book) a(x) WHERE x NOT IN (SELECT account_id FROM customers))
  AS accounts_not_in_customers FROM sent""",
    ),
)
def profile_accounts(spark, sf_dir):
    return profiling.account_activity(
        testbook.raw_text(spark, sf_dir), testbook.customers(spark, sf_dir)
    )


@query(
    "imputation_agreement",
    with_tables(
        CLEAN,
        """SELECT count(*) AS known_rows, count(*) FILTER (sender_known = home_country) AS agreeing_rows,
  round(count(*) FILTER (sender_known = home_country) / CAST(count(*) AS DOUBLE), 4) AS agreement
FROM typed LEFT JOIN customers ON account_id = sender_account WHERE sender_known IS NOT NULL""",
    ),
)
def imputation_agreement(spark, sf_dir):
    return profiling.imputation_agreement(
        testbook.raw_book(spark, sf_dir), testbook.customers(spark, sf_dir), testbook.SPELLINGS
    )


@query(
    "amount_bands",
    with_tables(
        BOOK,
        " UNION ALL ".join(
            f"SELECT '{name}' AS band, count(*) FILTER ({test}) AS n FROM book"
            for name, test in {
                "70-100% of threshold": "amount >= 7000 AND amount < 10000",
                "90-100% of threshold": "amount >= 9000 AND amount < 10000",
                "at or above threshold": "amount >= 10000",
                "multiples of 1000": "amount % 1000 = 0 AND amount >= 1000",
                "multiples of 500": "amount % 500 = 0 AND amount >= 500",
                "whole amounts from 1000": "amount = round(amount) AND amount >= 1000",
            }.items()
        ),
    ),
)
def amount_bands(spark, sf_dir):
    return profiling.amount_bands(book(spark, sf_dir))


@query(
    "amount_histogram",
    with_tables(
        BOOK,
        """SELECT CAST(greatest(least(floor(amount / (5000.0 / 60)) + 1, 60), 1) AS BIGINT) AS bin,
  count(*) AS n FROM book WHERE amount IS NOT NULL GROUP BY 1""",
    ),
)
def amount_histogram(spark, sf_dir):
    return profiling.histogram(book(spark, sf_dir), F.col("amount"), 60, 0.0, 5000.0)


@query(
    "amount_histogram_log",
    with_tables(
        BOOK,
        """SELECT CAST(least(floor((x - lo) / ((hi - lo) / 60)) + 1, 60) AS BIGINT) AS bin, count(*) AS n
FROM (SELECT round(log10(amount), 9) AS x FROM book WHERE amount > 0),
  (SELECT min(round(log10(amount), 9)) AS lo, max(round(log10(amount), 9)) AS hi FROM book WHERE amount > 0)
GROUP BY 1""",
    ),
)
def amount_histogram_log(spark, sf_dir):
    positive = book(spark, sf_dir).filter("amount > 0")
    return profiling.histogram(positive, F.round(F.log10("amount"), 9), 60)


@query(
    "busiest_receivers_in_band",
    with_tables(
        BOOK,
        """SELECT receiver_account AS level, count(*) AS n FROM book
WHERE amount >= 9000 AND amount < 10000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""",
    ),
)
def busiest_receivers_in_band(spark, sf_dir):
    near = book(spark, sf_dir).filter("amount >= 9000 AND amount < 10000")
    return profiling.busiest(near, "receiver_account")


@query(
    "busiest_sender_first_rows",
    with_tables(
        BOOK,
        """SELECT transaction_id, us, amount FROM book WHERE sender_account = (SELECT sender_account
  FROM book GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY us, transaction_id LIMIT 8""",
    ),
)
def busiest_sender_first_rows(spark, sf_dir):
    return profiling.first_rows_of_busiest(book(spark, sf_dir)).select(
        "transaction_id", "us", "amount"
    )


@query(
    "profile_level_leak",
    with_tables(
        RAW,
        """SELECT count(*) AS n, min(left(transaction_id, 3)) = max(left(transaction_id, 3)) AS all_share_prefix,
  bool_and(coalesce(sender_country = receiver_country, false)) AS all_domestic,
  bool_or(coalesce(sender_country = receiver_country, false)) AS any_domestic,
  bool_and(channel IS NOT NULL) AS all_have_channel
FROM raw_book WHERE transaction_type = 'wire_transfer'""",
    ),
)
def profile_level_leak(spark, sf_dir):
    return profiling.level_leak(testbook.raw_text(spark, sf_dir), "transaction_type", "wire_transfer")

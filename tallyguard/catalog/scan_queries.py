"""Readers: every query writes a feed to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import new_folder
from ..sources import files, scan, schemas, testbook
from .inputs import book
from .registry import query
from .tables_sql import BOOK, CUSTOMERS, HIGH_RISK_SQL, LABEL_FILE, RAW, with_tables

_RAW_ROW = """transaction_id, ts_text AS "timestamp", sender_account, receiver_account, {amount}, currency,
  sender_country, receiver_country, transaction_type, channel"""


def _csv(spark, df, name):
    path = new_folder(spark, name)
    files.write_table(df, path, "csv")
    return path


@query("scan_raw", with_tables(RAW, f"SELECT {_RAW_ROW.format(amount='amount')} FROM raw_book"))
def scan_raw(spark, sf_dir):
    """S1: typed CSV; blanks around names survive, blank cells are NULL."""
    return files.read_raw(spark, _csv(spark, testbook.raw_text(spark, sf_dir), "feed"))


@query(
    "scan_raw_text",
    with_tables(
        RAW,
        """SELECT transaction_type, channel, sender_country, count(*) AS n,
  count(amount) AS amounts, sum(CAST(round(amount * 100) AS BIGINT)) AS pennies,
  sum(length(ts_text)) AS time_letters FROM raw_book GROUP BY 1, 2, 3""",
    ),
)
def scan_raw_text(spark, sf_dir):
    """S2: every column as text, interpreted by the query alone."""
    text = files.read_raw_text(spark, _csv(spark, testbook.raw_text(spark, sf_dir), "feed"))
    pennies = F.round(F.col("amount").cast("double") * 100).cast("bigint")
    return text.groupBy("transaction_type", "channel", "sender_country").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("amount").alias("amounts"),
        F.sum(pennies).alias("pennies"),
        F.sum(F.length("timestamp")).alias("time_letters"),
    )


@query(
    "scan_customers",
    with_tables(
        BOOK + "," + CUSTOMERS,
        """SELECT account_id, home_country, strftime(account_open_date, '%Y-%m-%d') AS opened,
  CAST(year(account_open_date) AS INTEGER) AS open_year FROM customers""",
    ),
)
def scan_customers(spark, sf_dir):
    """S3: a date column is a date."""
    path = _csv(spark, testbook.customers(spark, sf_dir), "customers")
    return files.read_customers(spark, path).select(
        "account_id",
        "home_country",
        F.date_format("account_open_date", "yyyy-MM-dd").alias("opened"),
        F.year("account_open_date").alias("open_year"),
    )


@query(
    "scan_labels",
    with_tables(
        LABEL_FILE,
        "SELECT is_laundering_pattern, count(*) AS n, count(DISTINCT transaction_id) AS ids "
        "FROM label_file GROUP BY 1",
    ),
)
def scan_labels(spark, sf_dir):
    path = _csv(spark, testbook.labels(spark, sf_dir), "labels")
    return files.read_labels(spark, path).groupBy("is_laundering_pattern").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("transaction_id").alias("ids")
    )


_NUMBER = "CAST(right(transaction_id, 8) AS BIGINT)"


def _number() -> Column:
    return F.expr(_NUMBER)


def _broken_feed(spark, sf_dir):
    """The feed as lines of text: some have an amount that is none, some lack their last
    fields, some have a field too many."""
    raw = testbook.raw_text(spark, sf_dir).withColumn(
        "amount", F.when(_number() % 400 == 21, "n/a").otherwise(F.col("amount"))
    )
    spaces = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*schemas.RAW_COLUMNS), spaces)
    lines = raw.select(
        F.when(_number() % 400 == 22, F.substring_index(line, ",", 4))
        .when(_number() % 400 == 23, F.concat(line, F.lit(",more")))
        .otherwise(line)
        .alias("value")
    )
    path = new_folder(spark, "broken")
    lines.write.text(path)
    return scan.split(scan.scan_csv(spark, path, schemas.RAW, header=False))


_GOOD = f"({_NUMBER}) % 400 NOT IN (21, 22, 23)"


@query(
    "scan_unreadable",
    with_tables(
        RAW,
        f"""SELECT transaction_id, sender_account, CASE WHEN ({_NUMBER}) % 400 = 21
    THEN 'unreadable: amount' ELSE 'unreadable: number of fields' END AS quarantine_reason,
  CASE ({_NUMBER}) % 400 WHEN 21 THEN 9 WHEN 22 THEN 3 ELSE 10 END AS commas
FROM raw_book WHERE NOT ({_GOOD})""",
    ),
)
def scan_unreadable(spark, sf_dir):
    """Lines that do not fit, with their reason and their whole text."""
    _, bad = _broken_feed(spark, sf_dir)
    commas = F.length(scan.LINE) - F.length(F.replace(scan.LINE, F.lit(","), F.lit("")))
    return bad.select(
        "transaction_id", "sender_account", scan.REASON, commas.alias("commas")
    )


@query(
    "scan_readable",
    with_tables(RAW, f"SELECT {_RAW_ROW.format(amount='amount')} FROM raw_book WHERE {_GOOD}"),
)
def scan_readable(spark, sf_dir):
    """The other lines of the same feed, none lost and none changed."""
    return _broken_feed(spark, sf_dir)[0]


def _documents(spark, sf_dir):
    """A payment as a nested document; a leg without a country has no such field."""
    rows = book(spark, sf_dir)
    legs = [
        F.struct(
            F.lit(side).alias("side"),
            F.col(f"{side}_account").alias("account"),
            F.col(f"{side}_country").alias("country"),
        )
        for side in ("sender", "receiver")
    ]
    documents = rows.select(
        F.to_json(
            F.struct(
                "transaction_id",
                F.struct("amount", "currency").alias("money"),
                F.array(*legs).alias("legs"),
            )
        ).alias("value")
    )
    path = new_folder(spark, "documents")
    documents.write.text(path)
    return scan.read_documents(spark, path)


@query("scan_documents", with_tables(BOOK, "SELECT transaction_id, amount, currency FROM book"))
def scan_documents(spark, sf_dir):
    """S4: nested JSON through VARIANT, no schema given or inferred."""
    wanted = {
        "transaction_id": ("$.transaction_id", "string"),
        "amount": ("$.money.amount", "double"),
        "currency": ("$.money.currency", "string"),
    }
    return _documents(spark, sf_dir).select(*scan.fields(F.col("document"), wanted))


@query(
    "scan_document_elements",
    with_tables(
        BOOK,
        """SELECT transaction_id, 0 AS place, 'sender' AS side, sender_account AS account,
  sender_country AS country FROM book
UNION ALL SELECT transaction_id, 1, 'receiver', receiver_account, receiver_country FROM book""",
    ),
)
def scan_document_elements(spark, sf_dir):
    """One row per element of the array inside each document."""
    wanted = {c: (f"$.{c}", "string") for c in ("side", "account", "country")}
    key = {"transaction_id": ("$.transaction_id", "string")}
    return scan.elements(_documents(spark, sf_dir), "$.legs").select(
        *scan.fields(F.col("document"), key), "place", *scan.fields(F.col("element"), wanted)
    )


@query(
    "scan_rows",
    with_tables(
        BOOK,
        f"""SELECT sender_country AS country, 1.5 AS weight, count(*) AS payments,
  CAST(sum(cents) AS BIGINT) AS pennies
FROM book WHERE sender_country IN {HIGH_RISK_SQL} GROUP BY 1""",
    ),
)
def scan_rows(spark, sf_dir):
    """S5: a hand-written table of rows meets the book."""
    schema = T.StructType(
        [T.StructField("country", T.StringType()), T.StructField("weight", T.DoubleType())]
    )
    listed = files.from_rows(
        spark, [{"country": c, "weight": 1.5} for c in testbook.HIGH_RISK], schema
    )
    totals = (
        book(spark, sf_dir)
        .groupBy(F.col("sender_country").alias("country"))
        .agg(
            F.count(F.lit(1)).alias("payments"),
            F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("pennies"),
        )
    )
    return listed.join(totals, "country")

"""The payment book derived from the supplied tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import with_derived
from ..session import configure

SPELLINGS = {"nation_2": "NATION_2", "n.2": "NATION_2", "n2": "NATION_2"}
HIGH_RISK = ("NATION_2", "NATION_5", "NATION_13")


# columns read from the supplied tables; declared, so that no file is opened to infer them
SUPPLIED = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(SUPPLIED[name]).parquet(f"{sf_dir}/{name}.parquet")


def _account(col: Column) -> Column:
    return F.concat(F.lit("ACC"), F.lpad(col.cast("string"), 6, "0"))


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country per customer. Grouped, so that the optimizer sees one row per key and drops
    the joins wherever no country is asked for."""
    customer = (
        _read(spark, sf_dir, "customer")
        .groupBy("c_custkey")
        .agg(F.min("c_nationkey").alias("n_nationkey"))
    )
    nation = (
        _read(spark, sf_dir, "nation").groupBy("n_nationkey").agg(F.min("n_name").alias("n_name"))
    )
    return customer.join(nation, "n_nationkey", "left").select("c_custkey", "n_name")


@lru_cache(maxsize=64)
def _accounts_in_use(spark: SparkSession, sf_dir: str) -> int:
    return _read(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _accounts_in_use(spark, sf_dir)
    homes = _homes(spark, sf_dir)
    legs = _read(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").alias("s"),
        ((F.col("user_id") * 7 + F.col("event_id") % 13 + 1) % n).alias("r"),
        F.round(F.col("value") * 40, 2).alias("amount"),
        F.when(F.col("event_type") == "signup", "transfer")
        .otherwise(F.col("event_type"))
        .alias("transaction_type"),
    )
    channel = F.array(
        *[
            F.lit(c)
            for c in (
                "wire_transfer",
                "mobile_app",
                "card_payment",
                "online_transfer",
                "atm_withdrawal",
            )
        ]
    )
    sender = homes.select(F.col("c_custkey").alias("s"), F.col("n_name").alias("sender_country"))
    receiver = homes.select(
        F.col("c_custkey").alias("r"), F.col("n_name").alias("receiver_country")
    )
    return (
        legs.join(sender, "s", "left")
        .join(receiver, "r", "left")
        .select(
            "event_id",
            F.concat(F.lit("TXN"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias(
                "transaction_id"
            ),
            "timestamp",
            _account(F.col("s")).alias("sender_account"),
            _account(F.col("r")).alias("receiver_account"),
            "amount",
            F.lit("GBP").alias("currency"),
            "sender_country",
            "receiver_country",
            "transaction_type",
            F.element_at(channel, (F.col("event_id") % 5 + 1).cast("int")).alias("channel"),
        )
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-shaped book, microsecond times."""
    return with_derived(_payments(spark, sf_dir).drop("event_id"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _accounts_in_use(spark, sf_dir)
    return (
        _homes(spark, sf_dir)
        .filter(F.col("c_custkey") < n)
        .select(
            _account(F.col("c_custkey")).alias("account_id"),
            F.col("n_name").alias("home_country"),
            F.date_add(F.lit("2018-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int"))
            .alias("account_open_date"),
        )
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label file with replayed rows, as it mirrors the raw file."""
    events = _read(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("TXN"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias(
            "transaction_id"
        ),
        ((F.col("event_type") == "error") & (F.col("value") * 40 >= 7000))
        .cast("int")
        .alias("is_laundering_pattern"),
        F.explode(
            F.when(F.col("event_id") % 500 == 7, F.array(F.lit(0), F.lit(1))).otherwise(
                F.array(F.lit(0))
            )
        ).alias("copy"),
    ).drop("copy")


def raw_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book as a raw feed delivers it: text times and planted defects."""
    e = F.col("event_id")
    plain = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    slash = F.date_format("timestamp", "dd/MM/yyyy HH:mm")
    sender, receiver = F.col("sender_country"), F.col("receiver_country")
    copies = (
        F.when(e % 500 == 7, F.array(F.lit(0), F.lit(0)))
        .when(e % 1000 == 13, F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))
    )
    return (
        _payments(spark, sf_dir)
        .withColumn("copy", F.explode(copies))
        .select(
            "transaction_id",
            F.when((e % 20 == 0) | (F.col("copy") == 1), slash).otherwise(plain).alias("timestamp"),
            "sender_account",
            "receiver_account",
            F.when(e % 1000 == 5, -F.col("amount"))
            .when(e % 1000 != 3, F.col("amount"))
            .alias("amount"),
            "currency",
            F.when(e % 100 == 11, F.lit(None).cast("string"))
            .when((sender == "NATION_2") & (e % 3 == 1), " nation_2")
            .when((sender == "NATION_2") & (e % 3 == 2), "N.2")
            .otherwise(sender)
            .alias("sender_country"),
            F.when((receiver == "NATION_2") & (e % 3 == 1), "N2")
            .otherwise(receiver)
            .alias("receiver_country"),
            F.when(e % 250 == 9, "wire_transfer")
            .otherwise(F.col("transaction_type"))
            .alias("transaction_type"),
            F.when(e % 50 != 17, F.col("channel")).alias("channel"),
        )
    )


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw feed with every column as text."""
    return raw_book(spark, sf_dir).withColumn("amount", F.col("amount").cast("string"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings")

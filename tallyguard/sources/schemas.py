"""Fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()

RAW_COLUMNS = (
    "transaction_id",
    "timestamp",
    "sender_account",
    "receiver_account",
    "amount",
    "currency",
    "sender_country",
    "receiver_country",
    "transaction_type",
    "channel",
)
RAW_TEXT = T.StructType([T.StructField(c, _S) for c in RAW_COLUMNS])
RAW = T.StructType(
    [T.StructField(c, _D if c == "amount" else _S) for c in RAW_COLUMNS]
)
CLEAN = T.StructType(
    [
        T.StructField(
            c,
            {"amount": _D, "timestamp": T.TimestampType()}.get(c, _S),
        )
        for c in RAW_COLUMNS
    ]
    + [
        T.StructField("is_cross_border", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("date", T.DateType()),
    ]
)
CUSTOMERS = T.StructType(
    [
        T.StructField("account_id", _S),
        T.StructField("home_country", _S),
        T.StructField("account_open_date", T.DateType()),
    ]
)
LABELS = T.StructType(
    [
        T.StructField("transaction_id", _S),
        T.StructField("is_laundering_pattern", T.IntegerType()),
    ]
)

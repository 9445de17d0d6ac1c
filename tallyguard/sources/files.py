"""Readers and writers for the files a user brings or takes away."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import schemas


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """CSV with a header; blanks are NULL and unreadable cells become NULL."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("timestampFormat", timestamp_format)
        .option("dateFormat", date_format)
        .csv(path)
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RAW)


def read_raw_text(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, for profiling before anything is interpreted."""
    return read_csv(spark, path, schemas.RAW_TEXT)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CLEAN)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CUSTOMERS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LABELS)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def from_rows(
    spark: SparkSession, rows: Iterable[Mapping], schema: T.StructType
) -> DataFrame:
    """A small hand-written table."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table; CSV keeps a header and a sortable timestamp format."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    writer.format(fmt).save(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, nested columns kept."""
    df.write.mode(mode).json(path)


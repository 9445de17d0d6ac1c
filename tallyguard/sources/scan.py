"""Scans that keep what they cannot read, and nested documents without a fixed schema.

A line with too few or too many fields, or with a cell that is no value of its column, is
not dropped and does not pass as a row with a missing value: the scan keeps its text, and
:func:`split` hands it on with a reason, in the shape of the quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import stage

LINE = "unreadable_line"
REASON = "quarantine_reason"
WRONG_COUNT = "unreadable: number of fields"


def _with(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, T.StringType())])


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Every line of the files; ``unreadable_line`` holds the text of those that do not fit.

    Blank cells are NULL and readable. Blank lines are no rows.
    """
    return (
        spark.read.schema(_with(schema, LINE))
        .option("header", header)
        .option("enforceSchema", not header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", LINE)
        .option("timestampFormat", timestamp_format)
        .option("dateFormat", date_format)
        .csv(path)
    )


def _reason(schema: T.StructType) -> Column:
    """Which fields of the kept text are no values of their columns."""
    text = ", ".join(f"`{name}` string" for name in [*schema.fieldNames(), "_misfit"])
    cells = F.from_csv(LINE, text, {"columnNameOfCorruptRecord": "_misfit"})
    unread = F.array_compact(
        F.array(
            *[
                F.when(cells[f.name].isNotNull() & F.col(f.name).isNull(), F.lit(f.name))
                for f in schema.fields
            ]
        )
    )
    return F.when(cells["_misfit"].isNotNull(), F.lit(WRONG_COUNT)).otherwise(
        F.concat(F.lit("unreadable: "), F.array_join(unread, ", "))
    )


def split(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that fit, and the others with their reason and their text.

    The scan is staged first: files are parsed once, with all their columns (a pruned scan
    does not see bad cells of the columns it leaves out), and both parts read the staged rows.
    """
    schema = T.StructType([f for f in scanned.schema.fields if f.name != LINE])
    rows = stage(scanned, "scan")
    bad = rows.filter(F.col(LINE).isNotNull())
    return (
        rows.filter(F.col(LINE).isNull()).drop(LINE),
        bad.select(*schema.fieldNames(), _reason(schema).alias(REASON), LINE),
    )


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON of any shape as one VARIANT per document, in column ``document``.

    With ``multi_line`` a file is one document; where it is an array, ``elements(documents,
    "$")`` are its items. Otherwise every line is a document.
    """
    return (
        spark.read.option("singleVariantColumn", "document")
        .option("multiLine", multi_line)
        .json(path)
    )


def fields(document: Column, paths: dict[str, tuple[str, str]]) -> list[Column]:
    """Columns ``name: (path, type)`` of a VARIANT; NULL where absent or of another type."""
    return [F.try_variant_get(document, path, kind).alias(n) for n, (path, kind) in paths.items()]


def elements(documents: DataFrame, path: str, *keep: str) -> DataFrame:
    """One row per element of the array at ``path``, with its place; none for an absent array."""
    array = F.try_variant_get("document", path, "array<variant>")
    return documents.select(*keep, "document", F.posexplode(array).alias("place", "element"))

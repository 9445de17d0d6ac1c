"""Tables that a rerun can neither double nor mix.

A table is written into a folder of its own, in one job, and counts as published once a
row of its manifest says so. The manifest is a table of a row per publication, appended as a
single file that the commit of the job makes visible at once. A driver that is lost while
writing leaves a folder that no manifest row names, and readers never look into it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = (
    "run string, folder string, published_us bigint, schema string, metrics map<string, bigint>"
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All publications of a table, none where nothing was ever published."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def published(spark: SparkSession, path: str, run: str | None = None) -> Row | None:
    """The first publication of a run, or the last of all; None where there is none.

    Two drivers that publish one run at once both write a row; the first holds for everybody.
    """
    rows = manifest(spark, path)
    if run is None:
        return rows.orderBy(F.desc("published_us"), F.desc("folder")).first()
    return rows.filter(F.col("run") == run).orderBy("published_us", "folder").first()


def publish(
    df: DataFrame,
    path: str,
    run: str | None = None,
    by: tuple[str, ...] = (),
    metrics: dict[str, Column] | None = None,
) -> Row:
    """Write ``df`` once, split into subfolders ``by`` columns, and publish it.

    A run that is published already is not written again. ``metrics`` are whole-number
    aggregates observed while writing, at no further pass, and kept in the manifest; ``rows``
    is always one of them. They are observed in the tasks that write, whose counts Spark takes
    once per partition however often a lost executor makes them run.
    """
    spark = df.sparkSession
    done = published(spark, path, run) if run is not None else None
    if done is not None:
        return done
    folder = f"data/{uuid.uuid4().hex}"
    counted = {"rows": F.count(F.lit(1)), **(metrics or {})}
    seen = Observation(f"publish-{folder}")
    observed = df.observe(seen, *[c.cast("bigint").alias(name) for name, c in counted.items()])
    observed.write.partitionBy(*by).parquet(f"{path}/{folder}")
    counts = {name: seen.get[name] for name in counted}
    row = (run, folder, time.time_ns() // 1000, json.dumps(df.schema.jsonValue()), counts)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return published(spark, path, run)


def read_published(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The published table; a filter on a column it is split by reads that subfolder alone.

    An empty text in such a column comes back as NULL, as folder names cannot hold it.
    """
    row = published(spark, path, run)
    if row is None:
        raise FileNotFoundError(f"nothing is published at {path}" + (f" for {run}" if run else ""))
    schema = T.StructType.fromJson(json.loads(row["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/{row['folder']}").select(*schema.names)


def observed_metrics(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The metrics of a publication as one row of columns, in alphabetical order."""
    row = published(spark, path, run)
    if row is None:
        raise FileNotFoundError(f"nothing is published at {path}" + (f" for {run}" if run else ""))
    names = sorted(row["metrics"])
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    return spark.createDataFrame([tuple(row["metrics"][n] for n in names)], schema)

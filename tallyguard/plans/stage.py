"""Cut a lineage by writing a table to the shared folder of the cluster."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


_local_roots: dict[str, str] = {}


class _Scopes:
    """The paths that :func:`passing` collects. A process has its own, the package travels by value."""

    def __init__(self) -> None:
        self.paths: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)

    def __reduce__(self):
        return _Scopes, ()


_scopes = _Scopes()


def stage_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only in local mode where it is unset."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder every executor can read")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="tallyguard-")
    return _local_roots[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder nobody has used, among what this application has staged."""
    application = spark.sparkContext.applicationId
    return f"{stage_root(spark)}/tallyguard-{application}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and continue from the files.

    The files outlive lost executors, are columnar (later reads prune columns and push
    filters) and freeze whatever was decided while writing, such as range boundaries. They
    lie in one folder per application, to be removed when the application is over.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if (paths := _scopes.paths.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Remove what this application has staged; tables that still read it are lost."""
    _remove(spark, f"{stage_root(spark)}/tallyguard-{spark.sparkContext.applicationId}")


def discard(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    _remove(table.sparkSession, table._staged)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside is removed at the end; nothing that is read later may depend on it.

    The function that it gives takes a staged table out of this and returns it.
    """
    paths: list[str] = []
    token = _scopes.paths.set(paths)

    def keep(table: DataFrame) -> DataFrame:
        paths.remove(table._staged)
        if token.old_value not in (None, contextvars.Token.MISSING):
            token.old_value.append(table._staged)
        return table

    try:
        yield keep
    finally:
        _scopes.paths.reset(token)
        for path in paths:
            _remove(spark, path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a while, where this version of Spark has it."""
    if not spark.conf.isModifiable(name):
        yield
        return
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """Let Spark delete a job's shuffle files when the job is over; what it wrote stays."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def together(*actions: Callable[[], Any], most: int | None = None) -> list[Any]:
    """Submit independent Spark actions at once, so that short ones fill the gaps of long ones.

    ``most`` bounds how many run at a time, where what they write meanwhile matters.
    """
    with ThreadPoolExecutor(max_workers=max(1, min(len(actions), most or len(actions)))) as pool:
        return [f.result() for f in [pool.submit(contextvars.copy_context().run, action) for action in actions]]

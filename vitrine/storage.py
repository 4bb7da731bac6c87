"""Written intermediate tables: where lineage is cut and jobs can pick up after losing an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches, taken from the session's `spark.checkpoint.dir`.

    Only a local session (one machine) may go without the setting; it gets a temporary folder.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vitrine-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the shared folder; inside a `scratch` block in its folder, unless `lasting`."""
    folder = None if lasting else _scratch.get()
    return f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Take away written rows that nothing reads any more, in whatever store they are."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every action inside go when that action ends, not when the driver collects its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, other than `lasting` ones, go when the block ends; shuffle files go with their action.

    What leaves the block must read lasting tables only.
    """
    folder = fresh_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        with shuffles_dropped(spark):
            yield
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def materialise(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write `df` once and go on from the files, so later steps neither recompute nor diverge from it."""
    path = fresh_path(df.sparkSession, name, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

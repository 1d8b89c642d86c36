"""The folder that all executors share, and small helpers for tables in it."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="fileglade-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local-mode session may do without the setting: there the machine's own temporary
    folder is visible to every task.
    """
    base = spark.conf.get(_CHECKPOINT_DIR, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder that all executors reach")
        base = _own_folder()
    return f"{base.rstrip('/')}/fileglade-{uuid.uuid4().hex}"


def materialised(frame: DataFrame, spark: SparkSession) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, lineage cut."""
    path = f"{shared_folder(spark)}/table"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, target = _filesystem(spark, path)
    return filesystem.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a storage folder and what is in it, if there is one."""
    filesystem, target = _filesystem(spark, path)
    if filesystem.exists(target):
        filesystem.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    filesystem, target = _filesystem(spark, path)
    filesystem.mkdirs(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a storage folder; none if there is no such folder."""
    filesystem, target = _filesystem(spark, path)
    if not filesystem.exists(target):
        return []
    return [status.getPath().getName() for status in filesystem.listStatus(target)]

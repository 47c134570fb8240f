"""The folder that the driver and all executors share, and what a job keeps in it for a while."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Scopes(threading.local):
    """The scratch() scopes that a thread is in, so that threads don't remove each other's tables."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a new temporary folder if driver and executors are one process; else an
    error, as executors would write to disks of their own and rows would be missed without a word."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed at the end of the scratch() that it is made in, if any."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    return path


def kept(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends here, and a lost executor takes none of it.

    It stays until the end of the scratch() that it is made in, if any."""
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is kept inside is removed at the end, so results made of it must be written or collected before."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            remove(spark, path)

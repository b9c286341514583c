"""One file from a Spark write, and small files through Spark's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def single_file(data: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Write data by one task into a folder beside path and move its one file there."""
    spark = data.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    write(data.coalesce(1), folder)
    target, fs = _fs(spark, path)
    try:
        parts = fs.globStatus(_fs(spark, f"{folder}/part-*")[0])
        if fs.exists(target):
            fs.delete(target, True)
        fs.rename(parts[0].getPath(), target)
    finally:
        fs.delete(_fs(spark, folder)[0], True)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of bytes that the driver holds."""
    target, fs = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(content)
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A file's bytes on the driver; for small files."""
    found = spark.read.format("binaryFile").load(path).select("content").first()
    if found is None:
        raise FileNotFoundError(path)
    return bytes(found[0])

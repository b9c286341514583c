"""Frames' filters and aggregations over streams of files, by Structured Streaming.

An extension: frames themselves are of files at rest. The same predicates and
aggregates go into streaming plans, as they are Spark expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.frame import Frame
from tabwright.storage import scratch_root


def read_stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """Parquet files of a path, and those that arrive, as a stream of one schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    # A path may be one file or a folder of files.
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def running_totals(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, n, total) of the rows with a positive value that a stream has brought so far.

    The state is a row a key, its checkpoint in the shared folder; the result is
    written by the stream as a table there and read when the files at hand are
    through.
    """
    rows = Frame(read_stream(spark, path).select(key, value))
    kept = rows.where(rows[value].greater_than(0.0))
    totals = kept.data.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    place = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table")

    run = totals.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").foreachBatch(replace).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{place}/table")


def windowed_counts(events: DataFrame, time: str, window: str, late: str, key: str) -> DataFrame:
    """Events of each window and key; state of windows older than the watermark is dropped, and events later than it aren't counted."""
    # Watermarks need instants; times without a zone are taken in the session's.
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))

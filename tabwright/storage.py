"""Tables that cut lineage, in the folder that the cluster shares, and global row numbers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    ``spark.checkpoint.dir`` where the cluster names one. Where it is unset, a
    local session (tests) takes the machine's temporary folder and any other
    session a folder beside the warehouse, which its executors share.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if (conf.get("spark.master") or "").startswith("local[") or conf.get("spark.master") == "local":
        return f"file://{tempfile.gettempdir()}/tabwright-scratch"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


_records: list[list[str]] = []


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of the tables that are materialized meanwhile."""
    paths: list[str] = []
    _records.append(paths)
    try:
        yield paths
    finally:
        _records.remove(paths)


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back.

    The result no longer depends on executors that computed it, and no later
    stage computes it again. Its path is in ``result.inputFiles()``.
    """
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    for paths in _records:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    root = scratch_root(df.sparkSession).removeprefix("file:").lstrip("/")
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if root in folder:
            discard_path(df.sparkSession, folder)


def discard_path(spark: SparkSession, folder: str) -> None:
    """Delete a materialized table by its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partition_offsets(df: DataFrame, amount: Column, part: Column) -> DataFrame:
    """What the partitions before each one hold in all: (part, before).

    One row a partition, by prefix sums over partition totals. The totals are
    pre-aggregated where they lie, and the window runs over as many rows as
    there are partitions.
    """
    totals = df.groupBy(part.alias("part")).agg(F.sum(amount).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("before"))


def global_order(df: DataFrame, keys: list[Column], label: str, name: str = "order_id") -> DataFrame:
    """Number all rows 0, 1, ... in the order of keys, as a bigint column of the given name.

    A range shuffle deals the rows out by the keys, each partition is sorted and
    written with the place of each row in its partition, and prefix sums over the
    partitions' counts turn these into places overall. No task holds more than a
    range of the rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The id is the partition's number above bit 33 and the place in it below.
    kept = materialize(dealt.withColumn("__order_slot", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("__order_slot", 33), F.col("__order_slot").bitwiseAND((1 << 33) - 1)
    offsets = partition_offsets(kept, F.lit(1), part)
    return (
        kept.withColumn("__part", part)
        .join(F.broadcast(offsets.toDF("__part", "__before")), "__part")  # a row a partition
        .withColumn(name, F.col("__before") + place)
        .drop("__part", "__before", "__order_slot")
    )

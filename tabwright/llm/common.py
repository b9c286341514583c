"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.storage import discard, global_order, materialize, partition_offsets, recording, scratch_root

#: Bits of a filter of keys; as a table it has a 64th of this many rows at most, however many keys there are.
FILTER_BITS = 24


def _slot(key: str):
    return F.xxhash64(key).bitwiseAND((1 << FILTER_BITS) - 1)


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """(__hit_word, __hit_bits): a filter of the keys, of bounded size. Null keys leave a mark like any other."""
    slots = keys.select(_slot(key).alias("at"))
    marks = slots.select(F.shiftright("at", 6).alias("__hit_word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    return marks.groupBy("__hit_word").agg(F.bit_or("bit").alias("__hit_bits"))


def with_hit(rows: DataFrame, key: str, marks: DataFrame, name: str) -> DataFrame:
    """Add whether a row's key may be in a filter: always true for its keys, seldom for others while it isn't full."""
    at = _slot(key)
    joined = rows.withColumn("__hit_at", at).withColumn("__hit_word", F.shiftright("__hit_at", 6))
    joined = joined.join(F.broadcast(marks), "__hit_word", "left")  # 2^18 rows at most
    hit = F.expr("coalesce(shiftrightunsigned(__hit_bits, cast(__hit_at & 63 AS int)) & 1, 0) = 1")
    return joined.withColumn(name, hit).drop("__hit_at", "__hit_word", "__hit_bits")


def keyed(docs: DataFrame, label: str) -> DataFrame:
    """(__row, __key): each row whole, with a key that it has alone and that every scan gives it again.

    A row of Parquet files has its place in its file as key. Rows of any other plan
    are written first, as a plan may give other rows when it runs again.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or not docs.inputFiles()[:1]:
        docs = materialize(docs, label, compression="zstd")
    place = docs.metadataColumn("_metadata")
    key = F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), key.alias("__key"))


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among keys; rows that a filter clears aren't shuffled."""
    marked = with_hit(rows, key, materialize(bit_filter(keys, key), "filter"), "__hit")
    clear = marked.filter(~F.col("__hit")).drop("__hit")
    return clear.unionAll(marked.filter("__hit").drop("__hit").join(keys.select(key), key, "left_anti").select(*rows.columns))


__all__ = ["bit_filter", "discard", "global_order", "keyed", "materialize", "partition_offsets", "recording", "scratch_root", "with_hit", "without_keys"]

"""Shards that each hold the whole table's mixture of sources.

Rows are shuffled within their source by a seeded hash and ranked. A row of rank
r in a source of n rows stands at the fraction (r + 1/2) / n. In the order of
these fractions every stretch of rows holds each source in proportion, to within
a row, so equal cuts of it are shards that match the mixture. Both orders come
from range shuffles and prefix sums over partitions: no source is ever sorted or
ranked by one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import discard, global_order, materialize


def proportional_shards(rows: DataFrame, source_col: str, tie_cols: list[str], shards: int, seed: int = 42, label: str = "sharding") -> DataFrame:
    """Add shard (0 to shards - 1), slot (gapless from 0 in a shard) and fraction to rows.

    The shards' row counts differ by one at most. tie_cols name rows: with the
    seed they decide the shuffle, and rows that agree in them are taken in any
    order. A null source is a source; null tie columns are values of their own;
    repeated rows are placed each; an empty table stays empty. rows should be
    narrow: they are shuffled twice.
    """
    carried = rows.select(F.struct("*").alias("__row"), F.col(source_col).alias("__source"))
    draw = F.xxhash64(F.lit(seed), *[F.col(f"__row.{c}") for c in tie_cols], *[F.col(f"__row.{c}").isNull() for c in tie_cols])
    carried = carried.withColumn("__draw", draw)
    ties = [F.col(f"__row.{c}") for c in tie_cols]
    ranked = materialize(global_order(carried, [F.col("__source"), F.col("__draw"), *ties], f"{label}-by-source"), f"{label}-ranked")
    sources = ranked.groupBy("__source").agg(F.min("order_id").alias("__first"), F.count(F.lit(1)).alias("__n")).withColumnRenamed("__source", "__of")
    placed = (
        ranked.join(sources, F.equal_null("__source", "__of"))
        .withColumn("__fraction", (F.col("order_id") - F.col("__first") + 0.5) / F.col("__n"))
        .select("__row", "__source", "__draw", "__fraction")
    )
    lined_up = global_order(placed, [F.col("__fraction"), F.col("__source"), F.col("__draw"), *ties], f"{label}-by-fraction")
    total = ranked.count()
    discard(ranked)  # what read it is written by now
    # Shard s takes the places from ceil(s * total / shards) on.
    shard = F.expr(f"(order_id * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(bigint(shard) * {total}L + {shards - 1}L) div {shards}L")
    return (
        lined_up.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("order_id") - first)
        .select("__row.*", "shard", "slot", F.col("__fraction").alias("fraction"))
    )


def document_shards(docs: DataFrame, shards: int = 8, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 42) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot, fraction), a row for each row of docs.

    size is the text's UTF-8 bytes and one; a null text has size 1 and the CRC of
    no bytes. The text itself isn't shuffled. For other cases see
    ``proportional_shards``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return proportional_shards(narrow, "source", ["doc_id", "size", "text_crc32"], shards, seed)

"""URL filters against dated lists, in DataFrame functions only.

A list is a history: dated events add an entry with an action or remove it.
Events become intervals in which an entry holds, from its date up to the entry's
next event. A capture is evaluated as of the time it was fetched: its host's
suffixes, and its host with each beginning of its path, are the keys under which
entries can stand, and of the entries that hold at that time the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.common import materialize

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#][^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dots; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def validity_intervals(events: DataFrame) -> DataFrame:
    """(entry, action, valid_from, valid_to) from events (entry, action, since).

    action is ``block``, ``allow`` or ``remove``. An entry holds from an event's
    time up to its next event's (excluded; null: until now on); of several events
    at one time the last by name holds. Entries without text or time are none.
    """
    clean = events.filter(F.col("entry").isNotNull() & (F.col("entry") != "") & F.col("since").isNotNull() & F.col("action").isNotNull())
    # Hosts ignore case, paths don't.
    host = F.substring_index("entry", "/", 1)
    entry = F.concat(F.lower(host), F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)"))
    once = clean.groupBy(entry.alias("entry"), F.col("since").alias("valid_from")).agg(F.max("action").alias("action"))
    until = F.lead("valid_from").over(Window.partitionBy("entry").orderBy("valid_from"))
    return once.withColumn("valid_to", until).filter("action IN ('block', 'allow')").select("entry", "action", "valid_from", "valid_to")


def keys_of(url: Column, host: Column, depth: int = 1) -> Column:
    """Keys under which entries for a URL can stand: its host's suffixes, and its host with the first 1 to depth path segments."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    parts = F.slice(F.split(path, "/"), 1, depth)
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host != "", F.concat(suffixes, F.when(path != "", paths).otherwise(F.array().cast("array<string>"))))


def filter_urls(captures: DataFrame, events: DataFrame, url_col: str = "url", id_col: str = "page_id", time_col: str = "fetched_at") -> DataFrame:
    """(page_id, url, host, fetched_at, n_active, entry, action, valid_from, blocked), a row for each capture.

    n_active counts the entries that hold for the capture when it was fetched;
    entry, action and valid_from are of the longest of them (null without), and
    blocked tells whether that blocks. A null URL, one without a host, and a null
    time match nothing. Repeated captures each have a row; an empty list blocks
    nothing; empty captures give no rows; other columns are passed over. Distinct
    pairs of keys and time are evaluated once, however many captures
    have them, and what they give is written, so that the rows of a hot host and
    day are split by adaptive execution; captures that match nothing, as they lack
    a host or a time, go around the join. The list is broadcast only if Spark
    finds it small enough.
    """
    url = F.col(url_col)
    picked = captures.select(F.col(id_col).alias("page_id"), url.alias("url"), F.col(time_col).alias("fetched_at"))
    picked = picked.withColumn("host", host_of(F.col("url")))
    # No key is longer than the deepest entry.
    deepest = events.agg(F.max(F.size(F.split("entry", "/")) - 1)).first()[0]
    picked = picked.withColumn("__key", keys_of(F.col("url"), F.col("host"), max(deepest or 0, 1)))
    distinct = picked.filter("__key IS NOT NULL AND fetched_at IS NOT NULL").select("__key", "fetched_at").distinct()
    held = distinct.select("__key", "fetched_at", F.explode("__key").alias("entry")).join(validity_intervals(events), "entry")
    held = held.filter("valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)")
    # The longest entry decides.
    best = held.groupBy("__key", "fetched_at").agg(
        F.count(F.lit(1)).alias("n_active"), F.max(F.struct(F.length("entry").alias("n"), "entry", "action", "valid_from")).alias("__best")
    )
    best = materialize(best, "url-best")
    matched = picked.filter("__key IS NOT NULL AND fetched_at IS NOT NULL").join(best, ["__key", "fetched_at"], "left")
    around = picked.filter("__key IS NULL OR fetched_at IS NULL").withColumns({"n_active": F.lit(None).cast("long"), "__best": F.lit(None).cast(best.schema["__best"].dataType)})
    return matched.unionByName(around).select(
        "page_id",
        "url",
        "host",
        "fetched_at",
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("__best.entry").alias("entry"),
        F.col("__best.action").alias("action"),
        F.col("__best.valid_from").alias("valid_from"),
        F.coalesce(F.col("__best.action") == "block", F.lit(False)).alias("blocked"),
    )

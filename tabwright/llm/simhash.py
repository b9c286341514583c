"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two linked fingerprints
must agree in one of them but for at most one bit: three segments for up to five
differing bits. Each segment is indexed as it is, and so many segments also once
for each of their bits with that bit wild. Where no segment agrees whole, each
differs, and then of four bits two segments have one each; so wild bits in any two
of three segments find every link of up to four bits. Two fingerprints meet under
the plain key of a segment that agrees, or under the key whose wild bit is the one
that differs. Meeting pairs are verified by counting the bits that differ.

Buckets are never expanded into all their pairs. Of a bucket of two or three, a
row of aggregates holds all members. In a larger bucket two pivots, its least and
its greatest fingerprint, take star links from all members within range, which
joins a group of near copies at a linear cost. Only buckets that still hold
several components are searched on, and there only the members outside the
bucket's largest component are compared with the rest, so no link between
different components is lost and no link inside one is emitted again.

Fingerprints, not documents, are the nodes: copies collapse first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import bit_filter, discard, keyed, materialize, with_hit, without_keys
from tabwright.llm.components import connected_components
from tabwright.llm.jaccard import link_sets, set_sizes

BITS = 64


#: Digests that a task holds at once, however long a text is.
_BLOCK = 65_536


def _bits_over_half(digests: Iterator[bytes], count: int) -> bytes:
    """A bit is 1 if it is set in over half the digests."""
    ones = np.zeros(BITS, dtype=np.int64)
    while block := list(itertools.islice(digests, _BLOCK)):
        codes = np.frombuffer(b"".join(block), dtype=np.uint8).reshape(-1, BITS // 8)
        ones += np.unpackbits(codes, axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > count).tobytes()


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """A text's SimHash over its word shingles, as a signed integer; 0 without words or for null.

    A-Z are lowered, words are runs of other than space and \\t to \\r, a shingle
    is so many words joined by spaces (fewer words: all of them) and repeats count
    each time. Shingles are hashed as UTF-8 by XXH64.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        found = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum([len(w) + 1 for w in parts])
        starts = [0, *ends[: len(parts) - shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        found = _bits_over_half((xxhash.xxh64_digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), len(starts))
    return int.from_bytes(found, "big", signed=True)


def simhash(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """``fingerprint`` as a bigint, in Arrow batches."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return run(text)


def segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments of 64 bits."""
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segments_needed(max_bits: int) -> int:
    """So few that one of them differs in at most one bit; two at least, so that a segment fits its key."""
    return max(2, max_bits // 2 + 1)


def wild_needed(max_bits: int) -> int:
    """How many segments need wild bits.

    Where all c segments differ, at most max_bits - c of them differ in two bits or
    more, so among one more than that some segment differs in one bit.
    """
    return max(0, max_bits - segments_needed(max_bits) + 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signature_rows(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(key, f): index rows of fingerprints f, a plain one for each segment and one for each wild bit.

    A key has the variant's number above bit 44, which is the wild bit's or from 64
    on the plain segment's, and the segment's other bits below.
    """
    variants, wild = [], wild_needed(max_bits)
    for s, (low, width) in enumerate(segments(segments_needed(max_bits))):
        mask = ((1 << width) - 1) << low
        variants.append(f"struct({BITS + s}L AS v, {_signed(mask)}L AS mask, {low} AS low)")
        if s < wild:
            variants += [f"struct({i}L AS v, {_signed(mask & ~(1 << i))}L AS mask, {low} AS low)" for i in range(low, low + width)]
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = nodes.repartition(spread).select("f", F.expr(f"inline(array({', '.join(variants)}))").alias("v", "mask", "low"))
    return each.select(F.expr("shiftleft(v, 44) | shiftrightunsigned(f & mask, low)").alias("key"), "f")


def _apart(a: str, b: str) -> Column:
    """Whether two fingerprints of one key differ in its wild bit; under a plain key always true."""
    place = "shiftrightunsigned(l.key, 44)"
    return F.expr(f"{place} >= {BITS} OR (shiftrightunsigned({a} ^ {b}, cast({place} AS int)) & 1) = 1")


def link_components(nodes: DataFrame, max_bits: int, label: str = "simhash") -> DataFrame:
    """(node, root) of every fingerprint linked to another, root the least reachable.

    nodes: a row for each distinct fingerprint f, a bigint that is never null. They
    link at max_bits or fewer differing bits; no link between components is missed.
    """

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits

    rows = signature_rows(nodes, max_bits)
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("f").alias("lo"), F.max("f").alias("hi"), F.bit_xor("f").alias("all")).filter("members > 1")
    buckets = buckets.withColumn("mid", F.expr("all ^ lo ^ hi"))
    # A bucket of two or three is decided by its row alone, and forgotten if its members are far apart.
    pairs = [("lo", "hi"), ("lo", "mid"), ("hi", "mid")]
    each = [F.when(near(a, b) & ((F.col("members") == 3) if b == "mid" else F.lit(True)), F.struct(F.col(a).alias("a"), F.col(b).alias("b"))) for a, b in pairs]
    found = buckets.withColumn("links", F.when(F.col("members") < 4, F.filter(F.array(*each), lambda x: x.isNotNull())))
    found = materialize(found.filter("members > 3 OR size(links) > 0").select("key", "lo", "hi", "links"), f"{label}-buckets")
    stars = found.filter("links IS NOT NULL").select(F.explode("links").alias("l")).select("l.a", "l.b")
    large = found.filter("links IS NULL").select("key", "lo", "hi")
    if large.isEmpty():
        result = connected_components(stars, f"{label}-stars")
        discard(found)
        return result

    # Larger buckets: star links to two pivots. Rows of other keys are cleared before the shuffle.
    marks = materialize(bit_filter(large, "key"), f"{label}-filter")
    index = with_hit(rows, "key", marks, "hit").filter("hit").drop("hit").join(large.hint("shuffle_hash"), "key")
    index = materialize(index, f"{label}-index")
    for pivot in ("lo", "hi"):
        stars = stars.unionAll(index.filter(near("f", pivot)).select(F.col("f").alias("a"), F.col(pivot).alias("b")).filter("a <> b"))
    first = connected_components(stars, f"{label}-stars")

    # What the pivots left apart: members of a bucket in different components.
    placed = index.select("key", "f").join(first.withColumnRenamed("node", "f"), "f", "left").select("key", "f", F.coalesce("root", "f").alias("root"))
    placed = materialize(placed, f"{label}-placed")
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    split = sizes.groupBy("key").agg(F.max_by("root", F.struct("members", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    split = materialize(split.select(F.col("key").alias("at"), "major"), f"{label}-split")
    minor = materialize(placed.join(split, (F.col("key") == F.col("at")) & (F.col("root") != F.col("major"))).select("key", "f", "root"), f"{label}-minor")
    open_keys = materialize(bit_filter(split, "at"), f"{label}-open")
    rest = with_hit(placed, "key", open_keys, "hit").filter("hit").drop("hit")
    meet = (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root")) & _apart("l.f", "r.f") & near("l.f", "r.f")
    links = minor.alias("l").join(rest.alias("r"), meet).select(F.col("l.root").alias("a"), F.col("r.root").alias("b"))
    links = materialize(links.distinct(), f"{label}-links")
    done = [found, marks, index, placed, split, minor, open_keys, links]
    if links.isEmpty():
        result = first
    else:
        second = connected_components(links, f"{label}-joined")
        linked = first.unionAll(second.select("node", F.col("node").alias("root")).join(first.select("node"), "node", "left_anti"))
        onward = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
        result = materialize(linked.join(onward, "root", "left").select("node", F.coalesce("top", "root").alias("root")), f"{label}-linked")
        done += [first, second]
    for table in done:
        discard(table)
    return result


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, max_bits: int = 4, label: str = "simhash") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Rows of equal fingerprints link; a text without words or a null text has
    fingerprint zero and links like any other. component_id is the least id in
    reach; a repeated id keeps all its rows, a null id takes part but names no
    component unless no other id is in reach (then null). An empty table gives an
    empty result; other columns are passed over.
    """
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col), shingle).alias("f")), f"{label}-prints")
    distinct = materialize(prints.groupBy("f").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), f"{label}-distinct")
    linked = link_components(distinct.select("f"), max_bits, label)
    of_links = distinct.join(linked.withColumnRenamed("node", "f"), "f")
    tops = of_links.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of_links.join(tops, "root").select("f", "component_id")
    # Fingerprints of one row without links are classes of their own.
    copied = distinct.filter("copies > 1").join(linked.select(F.col("node").alias("f")), "f", "left_anti").select("f", F.col("least").alias("component_id"))
    classes = materialize(classes.unionAll(copied), f"{label}-classes")
    discard(distinct)
    discard(linked)
    # Copies share a key: the classes are read from a table, so that a hot one is split.
    return prints.join(classes, "f", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def near_sets(prints: DataFrame, max_bits: int, label: str = "simhash") -> DataFrame:
    """(a, b): the shingle sets of each class of fingerprints, b, beside the least one, a.

    prints: a fingerprint f, and node and n of ``jaccard.set_sizes``; empty sets are
    passed over. Classes are what links of max_bits or fewer differing bits join.
    """
    sets = materialize(prints.filter("n > 0").select("f", "node").distinct(), f"{label}-sets")
    nodes = materialize(sets.select("f").distinct(), f"{label}-nodes")
    linked = link_components(nodes, max_bits, label)
    classed = sets.join(linked.withColumnRenamed("node", "linked"), F.col("f") == F.col("linked"), "left")
    classed = materialize(classed.select(F.coalesce("root", "f").alias("class"), "node").distinct(), f"{label}-classed")
    least = classed.groupBy("class").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last").select("class", "a")
    least = materialize(least, f"{label}-least")
    pairs = materialize(classed.join(least, "class").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), f"{label}-pairs")
    for table in (sets, nodes, linked, classed, least):
        discard(table)
    return pairs


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, max_bits: int = 4, label: str = "dedup") -> DataFrame:
    """The rows of docs without near duplicates: of each class the row of the least id (null last) stays.

    Texts are near duplicates at a Jaccard similarity of so much or more between
    their sets of shingles, and classes are what such links join. Texts whose
    fingerprints differ in max_bits or fewer are found through their signatures
    (``near_sets``) and verified on their whole sets. A similarity of 0.8 often means
    more bits than signatures can find, so ``jaccard.link_sets`` then looks for links
    between the classes so joined, and misses none; max_bits decides which step finds
    a link, never the result. Texts without words are all alike. Of rows of one id in a
    class, one stays. All columns of docs are returned, and no others; they are
    carried in one struct, so their names don't matter. Texts aren't copied: rows are
    known by their places, and those that stay are read from docs again.
    """
    whole = keyed(docs, f"{label}-docs")
    text = F.col(f"__row.`{text_col}`")
    at = F.xxhash64("__key").alias("__at")
    prints = whole.select("__key", at, F.col(f"__row.`{id_col}`").alias("id"), simhash(text, shingle).alias("f"), set_sizes(text, shingle).alias("__s"))
    prints = materialize(prints.select("__key", "__at", "id", "f", "__s.*"), f"{label}-prints", compression="zstd")
    near = near_sets(prints, max_bits, f"{label}-simhash")
    linked = link_sets(prints, whole.select(at, text.alias("__text")), near, shingle, similarity, label)
    copied = prints.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("node")
    classes = linked.select("node", F.col("root").alias("class")).union(copied.join(linked, "node", "left_anti").select("node", F.col("node").alias("class")))
    # A hot class is read from a table, so that its rows are split.
    classes = materialize(classes, f"{label}-classes")
    members = materialize(prints.join(classes, "node").select("__key", "id", "class"), f"{label}-members")
    first = members.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__key")).alias("first")).select("first.__key")
    others = materialize(members.select("__key").join(first, "__key", "left_anti"), f"{label}-others")
    for table in (prints, near, linked, classes, members):
        discard(table)
    return without_keys(whole, others, "__key").select("__row.*")

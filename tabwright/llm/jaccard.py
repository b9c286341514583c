"""Links of texts by the exact Jaccard similarity of their sets of word shingles, by prefix filtering.

All shingles stand in one order. Two sets of a similarity of s or more share a
shingle among the first n - ceil(s n) + 1 of each, so only these prefixes are
indexed and no pair is missed (Chaudhuri, Ganti and Kaushik 2006; the bound by
the shared shingle's places is that of Xiao et al. 2008). The order puts shingles
that a sample of the sets shows to be common last and the others by their hash.
Any order gives the same links; this one keeps buckets small.

Meeting pairs are first held against each other by bitmaps of about as many bits as
a set has shingles, each bit the parity of the shingles that fall on it. Two bitmaps
differ in no more bits than the sets do in shingles, so this clears pairs without
missing any (as Sandes, Teodoro and Melo 2020). What is left is verified on the
whole sets. Pairs that the caller knows of, as ``simhash`` does, are verified
before any search, and buckets only join what these leave apart. There each bucket's
members are held against one pivot; then, in buckets whose members are still in
several components, the members outside the largest one against the rest. So no link
between different components is lost and a group of near copies isn't expanded into
all its pairs.

Sets, not documents, are the nodes: copies collapse first.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import bit_filter, discard, materialize, with_hit
from tabwright.llm.components import connected_components

#: One in so many sets is sampled for common shingles; those in so many sampled sets count, the commonest only.
SAMPLE, COMMON, MOST = 8, 3, 65_536


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """A text's distinct shingles as XXH3 hashes of 64 bits, in order; words and shingles are as in ``simhash.fingerprint``."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.int64)
    joined, digest = b" ".join(parts), xxhash.xxh3_64_intdigest
    if len(parts) <= shingle:
        return np.array([digest(joined, seed)], dtype=np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = [0, *ends[: len(parts) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    each = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))
    return np.unique(each.view(np.int64))


def node_of(found: np.ndarray) -> int:
    """The number of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).astype(np.int64))


def set_sizes(text: Column, shingle: int) -> Column:
    """Struct of node, n and, for one set in SAMPLE, the set (else empty), in Arrow batches."""

    @F.pandas_udf("node long, n int, sample array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        # One set at a time; a slice would keep its whole set.
        rows = []
        for found in (shingle_set(t, shingle) for t in texts):
            node = node_of(found)
            rows.append((node, len(found), found if node % SAMPLE == 0 else np.empty(0, dtype=np.int64)))
        return pd.DataFrame(rows, columns=["node", "n", "sample"])

    return run(text)


def shingle_sets(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in texts])

    return run(text)


def bitmap(found: np.ndarray) -> bytes:
    """Parities of the shingles on each of 2^k bits, the least power of two that isn't below their number, 64 at least."""
    width = 1 << max(6, (len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (width - 1), minlength=width) & 1).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def may_link(similarity: Fraction) -> Callable[..., Column]:
    """Whether sets of n and m shingles can be so alike, by their bitmaps."""
    p, q = similarity.numerator, similarity.denominator

    @F.pandas_udf("boolean")
    def run(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([differing_bits(x, y) * (p + q) <= (i + k) * (q - p) for x, i, y, k in zip(a, n, b, m, strict=True)], dtype="boolean")

    return run


def prefixes(text: Column, shingle: int, similarity: Fraction, common: list[int]) -> Column:
    """Struct of node, n, the shingles that are indexed and the bitmap of all. common: shingles that stand last, the commonest first."""
    ranked = np.array(common, dtype=np.int64)
    order = np.argsort(ranked)
    keys, last = ranked[order], len(ranked)
    p, q = similarity.numerator, similarity.denominator

    def prefix(found: np.ndarray) -> np.ndarray:
        n = len(found)
        if last and n:
            at = np.minimum(np.searchsorted(keys, found), last - 1)
            place = np.where(keys[at] == found, last - order[at], 0)
            found = found[np.argsort(place, kind="stable")]
        return found[: n + (-p * n // q) + 1].copy() if n else found

    @F.pandas_udf("node long, n int, head array<long>, bits binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(node_of(found), len(found), prefix(found), bitmap(found)) for found in (shingle_set(t, shingle) for t in texts)]
        return pd.DataFrame(rows, columns=["node", "n", "head", "bits"])

    return run(text)


def link_sets(prints: DataFrame, texts: DataFrame, known: DataFrame, shingle: int, similarity: float, label: str = "jaccard") -> DataFrame:
    """(node, root) of every set linked to another, root the least node reachable.

    prints: a bigint ``__at`` that names a row, and the fields of ``set_sizes``;
    texts: ``__at`` and ``__text``; known: a table of pairs of nodes a < b that are
    likely to link. Sets link at a Jaccard similarity of so much or more, empty ones
    never; known pairs aren't taken on trust, and the links are the same whatever they are.
    """
    share = Fraction(similarity).limit_denominator(10_000)
    p, both = share.numerator, share.numerator + share.denominator

    sampled = prints.filter("size(sample) > 0").select("node", "sample").dropDuplicates(["node"])
    counts = sampled.select(F.explode("sample").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") >= COMMON)
    common = [r["token"] for r in counts.orderBy(F.desc("sets"), "token").limit(MOST).collect()]

    heads = texts.select(prefixes(F.col("__text"), shingle, share, common).alias("h")).select("h.*").filter("n > 0")
    heads = materialize(heads, f"{label}-heads")
    index = heads.select("node", "n", F.posexplode("head").alias("place", "token"))
    ends = index.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token")
    shared = materialize(ends, f"{label}-shared")
    marks = materialize(bit_filter(shared, "token"), f"{label}-filter")
    # Rows of other shingles are cleared before the shuffle, and copies collapse.
    index = with_hit(index, "token", marks, "hit").filter("hit").drop("hit").distinct()
    index = index.join(shared, "token", "left_semi")

    def may_reach(a: str, b: str) -> Column:
        """Whether the shingles from the shared one on suffice."""
        rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
        return rest.cast("long") * both >= (F.col(f"{a}.n").cast("long") + F.col(f"{b}.n")) * p

    def pair(a: str, b: str) -> list[Column]:
        x, y = F.col(f"{a}.node"), F.col(f"{b}.node")
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    least = prints.groupBy("node").agg(F.min("__at").alias("__at"))
    reach = may_link(share)

    def both_ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def cleared(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that the bitmaps don't rule out."""
        marks = materialize(bit_filter(both_ends(pairs), "node"), f"{label}-{name}-ends")
        maps = with_hit(heads.select("node", "n", "bits"), "node", marks, "hit").filter("hit").drop("hit")
        maps = materialize(maps.dropDuplicates(["node"]), f"{label}-{name}-maps")
        held = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b")
        left = materialize(held.filter(reach("x", "n", "y", "m")).select("a", "b"), f"{label}-{name}-cleared")
        for table in (marks, maps):
            discard(table)
        return left

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        pairs = cleared(candidates, name)
        wanted = materialize(both_ends(pairs).join(least, "node"), f"{label}-{name}-nodes")
        marks = materialize(bit_filter(wanted, "__at"), f"{label}-{name}-filter")
        near = with_hit(texts, "__at", marks, "hit").filter("hit")
        sets = near.select("__at", shingle_sets(F.col("__text"), shingle).alias("set")).join(wanted, "__at").select("node", "set")
        sets = materialize(sets, f"{label}-{name}-sets")
        held = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        alike = F.size(F.array_intersect("x", "y")).cast("long") * both >= (F.size("x").cast("long") + F.size("y")) * p
        links = materialize(held.filter(alike).select("a", "b"), f"{label}-{name}-links")
        for table in (pairs, wanted, marks, sets):
            discard(table)
        return links

    alike = verified(known, "known")
    joined = connected_components(alike, f"{label}-known")

    # Buckets of one component are done. Those of several: members of others than the pivot's are held against it.
    rooted = materialize(index.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{label}-rooted")
    pivots = rooted.groupBy("token").agg(F.min(F.struct("place", "node", "n", "root")).alias("r"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    first = rooted.alias("l").join(pivots.select("token", "r"), "token").filter("l.root <> r.root").filter(may_reach("l", "r")).select(*pair("l", "r")).distinct()
    first = materialize(first.join(known, ["a", "b"], "left_anti"), f"{label}-first")
    links = alike.unionAll(verified(first, "first"))
    roots = connected_components(links, f"{label}-stars")

    # What the pivots left apart: members of a bucket in different components.
    placed = materialize(rooted.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{label}-placed")
    sizes = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("members"))
    split = sizes.groupBy("token").agg(F.max_by("root", F.struct("members", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    split = materialize(split.select(F.col("token").alias("at"), "major"), f"{label}-split")
    minor = materialize(placed.join(split, (F.col("token") == F.col("at")) & (F.col("root") != F.col("major"))).drop("at", "major"), f"{label}-minor")
    open_tokens = materialize(bit_filter(split, "at"), f"{label}-open")
    rest = with_hit(placed, "token", open_tokens, "hit").filter("hit").drop("hit")
    second = minor.alias("l").join(rest.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.root") != F.col("r.root")) & may_reach("l", "r"))
    second = materialize(second.select(*pair("l", "r")).distinct().join(known.unionAll(first), ["a", "b"], "left_anti"), f"{label}-second")
    done = [heads, shared, marks, joined, rooted, first, links, placed, split, minor, open_tokens, second]
    result = roots
    if not second.isEmpty():
        more = verified(second, "second")
        if not more.isEmpty():
            result = connected_components(links.unionAll(more), f"{label}-joined")
            done.append(roots)
        done.append(more)
    for table in done:
        discard(table)
    return result

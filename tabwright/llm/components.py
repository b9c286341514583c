"""Connected components of an edge table by alternating large-star and small-star steps.

The method is that of Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii,
"Connected components in MapReduce and beyond" (SoCC 2014). Every step finds each
node's least neighbour, which is pre-aggregated before the shuffle and written, and
joins it to the edges. As both sides of the join are read from tables, the rows of
a node of very many edges are split by adaptive execution; beside an aggregation
in the same stage they couldn't be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import discard, materialize


def _large_star(edges: DataFrame, label: str) -> DataFrame:
    """Link each larger neighbour of a node to the node's least neighbour or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-least")
    # Edges run from the larger node a to the smaller b.
    linked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    result = materialize(linked, f"{label}-large")
    discard(least)
    return result


def _small_star(edges: DataFrame, label: str) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), f"{label}-least")
    linked = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    result = materialize(linked.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{label}-small")
    discard(least)
    return result


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Least reachable node of every node that has an edge, as a table that ``discard`` deletes.

    edges: columns a and b of bigint, in any direction, with repeats and loops
    allowed; rows with a null end are no edges. Returns (node, root) with a row
    for each node of an edge between different nodes, roots included; no edges,
    no rows.
    """
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    seen = _signature(now)
    while seen[0]:
        large = _large_star(now, label)
        then = _small_star(large, label)
        discard(now)
        discard(large)
        now, last, seen = then, seen, _signature(then)
        if seen == last:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    result = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), f"{label}-roots")
    discard(now)
    return result

"""SimHash, its index and components, and the stage that keeps one of each group."""

import random

import numpy as np
import pytest

from tabwright.llm import queries, simhash
from tabwright.llm.components import connected_components
from tests.llm import brute
from tests.llm.conftest import EDGE_ROWS

SF = "/root/testdata/sf0.001"


def unsigned(x):
    return x & (2**64 - 1)


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_fingerprint_equals_brute_force(small):
    for _, text in small[:60] + [(0, t) for _, t, _ in EDGE_ROWS if t is None or len(t) < 9000]:
        assert unsigned(simhash.fingerprint(text)) == brute.simhash(text)


def test_segments():
    assert simhash.segments_needed(4) == simhash.segments_needed(5) == 3 and simhash.segments_needed(0) == 2
    for count in (2, 3, 4, 5):
        cut = simhash.segments(count)
        assert sum(w for _, w in cut) == 64 and [a for a, _ in cut] == [sum(w for _, w in cut[:i]) for i in range(count)]
    assert [simhash.wild_needed(bits) for bits in (0, 2, 4, 5)] == [0, 1, 2, 3]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2064)] + [(5000, 5000)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    assert found == {x: top(x) for x in parent if x != 5000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(codes, linked):
    parent = list(range(len(codes)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if linked(codes[i], codes[j]):
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(codes)):
        groups.setdefault(top(i), set()).add(codes[i])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def planted(rng, words):
    """Random fingerprints, chains of few flips that drift apart, and a dense group of near copies."""

    def flip(code, bits):
        for b in rng.sample(range(64 * words), bits):
            code ^= 1 << b
        return code

    codes = {rng.getrandbits(64 * words) for _ in range(300)} | {0, 2 ** (64 * words) - 1}
    for _ in range(40):
        code = rng.getrandbits(64 * words)
        for _ in range(rng.randrange(2, 8)):
            codes.add(code)
            code = flip(code, rng.randrange(1, 6 * words))
    centre = rng.getrandbits(64 * words)
    codes |= {flip(centre, rng.randrange(1, 4)) for _ in range(400)}
    return sorted(codes)


@pytest.mark.parametrize(("seed", "bits"), [(1, 4), (2, 4), (3, 2), (4, 5)])
def test_links_are_complete(spark, seed, bits):
    codes = planted(random.Random(seed), 1)
    nodes = spark.createDataFrame([(signed(c),) for c in codes], "f long").repartition(3)
    found = {}
    for node, root in simhash.link_components(nodes, bits).collect():
        found.setdefault(root, set()).add(unsigned(node))
    assert {frozenset(g) for g in found.values()} == brute_components(codes, lambda a, b: (a ^ b).bit_count() <= bits)
    assert all(min(map(signed, g)) == r for r, g in found.items())


def test_index_rows_stay_in_proportion(spark, monkeypatch):
    """Each member of a group of near copies has 46 rows of the index at most, and no more that are compared, however large the group."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)

    def flip(bits):
        code = centre
        for b in rng.sample(range(64), bits):
            code ^= 1 << b
        return code

    keep = simhash.materialize
    for size in (500, 4000):
        codes = {rng.getrandbits(64) for _ in range(2000)}
        while len(codes) < 2000 + size:
            codes.add(flip(rng.randrange(1, 9)))
        rows = {}

        def counted(df, label, rows=rows):
            table = keep(df, label)
            if label.endswith(("-index", "-minor")):
                rows[label] = table.count()
            return table

        monkeypatch.setattr(simhash, "materialize", counted)
        simhash.link_components(spark.createDataFrame([(signed(c),) for c in codes], "f long").repartition(4), 4, "grown").count()
        assert set(rows) == {"grown-index", "grown-minor"}
        assert rows["grown-minor"] <= rows["grown-index"] <= 46 * size + 2000


def test_hot_nodes_are_split(spark):
    """The rows of a hub's join are split by adaptive execution, as both sides are read from tables."""
    from pyspark.sql import functions as F

    from tabwright.llm import components

    hot = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    plans, keep, before = [], components.materialize, {k: spark.conf.get(k, None) for k in hot}

    def seen(df, label):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    edges = keep(spark.range(200_000).select(F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.expr("id div 7")).alias("b"), (F.col("id") + 1_000_000).alias("a")).repartition(16), "hub")
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        components.materialize = seen
        components._large_star(edges.select("a", "b"), "hub")
        components._small_star(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), "hub")
    finally:
        components.materialize = keep
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in "".join(plans)


def test_op8_equals_brute_force(spark, small):
    assert sorted(map(tuple, queries.op8_simhash(spark, SF).collect())) == sorted(brute.op8(small))


def test_edge_rows(spark, edge, nothing):
    rows = [tuple(r) for r in simhash.near_duplicates(edge).collect()]
    want = brute.op8([(i, t) for i, t, _ in EDGE_ROWS])
    assert sorted(rows, key=str) == sorted(want, key=str)
    zero = {r[2] for r in rows if r[1] == "0" * 16}
    assert zero == {3}  # null, empty and blank texts are one class
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one(spark, edge, nothing):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and simhash.keep_one(nothing).count() == 0
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # 1, 2 and 2 are copies and a row of null id nearly so; 3, 4, 5 and the other row of null id have no words.
    assert ids == [1, 10, 11, 12, 13, 3, 7, 8, 9]
    assert {r["kept"] for r in kept.collect()} == {"own kept"}


def test_keep_one_finds_near_copies(spark):
    rng = np.random.default_rng(9)
    vocabulary = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)).decode() for _ in range(3000)]
    docs = []
    for i in range(60):
        words = [vocabulary[k] for k in rng.integers(0, 3000, 300)]
        docs.append((i, " ".join(words)))
        for c in range(3):
            copy = list(words)
            copy[int(rng.integers(300))] = f"edit{c}"
            docs.append((100 + 10 * i + c, " ".join(copy)))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(range(60)) <= kept and len(kept) <= 62

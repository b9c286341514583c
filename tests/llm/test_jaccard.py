"""The near-dedup stage against the exact similarity of all pairs."""

import duckdb
import numpy as np

from tabwright.llm import jaccard, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def keep_one(rows):
    """Ids of rows (doc_id, text) that are the least of their component over pairs of Jaccard similarity 0.8."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) and common:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {rows[i][0] for i in range(len(rows)) if top(i) == i}


def test_documents(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}/documents.parquet"
        rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}' ORDER BY doc_id").fetchall()
        assert {r["doc_id"] for r in simhash.keep_one(spark.read.parquet(path)).collect()} == keep_one(rows)


def test_pairs_about_the_threshold(spark):
    """Copies of texts of several lengths with edits that leave similarities on both sides of 0.8, and a family about one base."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**9)}"
    rows = []

    def edited(words, edits):
        out = list(words)
        for at in rng.choice(len(words), edits, replace=False):
            out[int(at)] = word()
        return out

    for size in (5, 9, 13, 14, 40, 100, 300):
        for _ in range(12):
            base = [word() for _ in range(size)]
            rows += [base, edited(base, max(1, round(size * rng.uniform(0.01, 0.04)))), base[: round(size * rng.uniform(0.75, 0.85))]]
    line = [word() for _ in range(12)]
    base = [word() for _ in range(150)]
    rows += [line + [word() for _ in range(30)] for _ in range(60)] + [line + edited(base, int(rng.integers(1, 8))) for _ in range(80)]
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == keep_one(rows)


def test_signatures_find_links_first(spark, monkeypatch):
    """Fingerprints link sets, which are verified; whatever they propose, all links are found and no other."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(10**9, size=300)]
        rows += [base, [*base[:-1], "end"], ["start", *base[1:]], base[:265], base[:200]]
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)] + [(90, "few"), (91, None), (92, ""), (93, "few")]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_one(rows)
    nodes = {i: jaccard.node_of(jaccard.shingle_set(t)) for i, t in rows[:60]}
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows[:60]}
    close = {tuple(sorted((nodes[i], nodes[j]))) for i in nodes for j in nodes if i < j and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4}
    top = {n: n for n in nodes.values()}
    for a, b in sorted(close) * 5:
        top[a] = top[b] = min(top[a], top[b])
    assert len(want) == 26 and 24 < len(set(top.values())) < 60  # signatures find some of the links in these 24 groups, not all
    found, searched = [], []
    near_sets, link_sets = simhash.near_sets, simhash.link_sets

    def seen(prints, max_bits, label):
        pairs = near_sets(prints, max_bits, label)
        found.append({(r["a"], r["b"]) for r in pairs.collect()})
        return pairs

    def handed(prints, texts, known, *rest):
        searched.append({(r["a"], r["b"]) for r in known.collect()})
        return link_sets(prints, texts, known, *rest)

    monkeypatch.setattr(simhash, "near_sets", seen)
    monkeypatch.setattr(simhash, "link_sets", handed)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want
    assert found == searched == [{(t, n) for n, t in top.items() if n != t}]

    every = sorted({*nodes.values(), jaccard.node_of(jaccard.shingle_set("few"))})
    for proposed in ([(every[0], b) for b in every[1:]], []):
        table = spark.createDataFrame(proposed, "a long, b long")
        monkeypatch.setattr(simhash, "near_sets", lambda *_, table=table: table)
        assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want

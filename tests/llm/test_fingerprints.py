"""Merkle fingerprints against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tabwright.llm import fingerprints, queries
from tests.llm import brute
from tests.llm.conftest import EDGE_ROWS, PROSE

SF = "/root/testdata/sf0.001"


def prints(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = fingerprints.add_tree(docs, F.col("text"), "tree").orderBy("i").select("tree.*").collect()
    return [r["fingerprint"] for r in rows]


def test_equal_prints_are_equal_texts(spark):
    texts = ["", "a", "a\n", "a\n\n", "a\n\n\n", "a \n\n", PROSE, PROSE + " ", PROSE.replace("fox", "cat"), "😀", "\n", "\n\n", None]
    found = prints(spark, texts)
    assert found[0] == found[-1]
    assert len(set(found)) == len(texts) - 1


def test_differing_branches(spark):
    a, b = PROSE, PROSE.replace("sleeps", "wakes")
    fa, fb = prints(spark, [a, b])
    row = spark.createDataFrame([(fa, fb)], "a string, b string").select(fingerprints.differing_branches(F.col("a"), F.col("b")), fingerprints.differing_branches(F.col("a"), F.col("a"))).first()
    assert [tuple(x) for x in row[0]] == [(0, 1)] and row[1] == []


def test_op1_edits(spark, small):
    want, texts = brute.op1_next(small), {i: t or "" for i, t in small}
    got = {r["doc_id"]: r for r in queries.op1_merkle(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (n, edited, j) in want.items():
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        text, following = texts[i], texts[j]
        assert r["fingerprint"] == brute.op1_tree(text)[0] and r["edited_fingerprint"] == brute.op1_tree(edited)[0]
        assert r["near_edited"] == pytest.approx(brute.op1_likeness(text, edited)) and r["near_next"] == pytest.approx(brute.op1_likeness(text, following))
        assert (r["fingerprint"] == got[j]["fingerprint"]) == (text == following)
    by_text = {}
    for i, t in small:
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.9 * len(got)


@pytest.mark.parametrize("size", [100, 4_000_000])
def test_neighbours_over_ranges(spark, edge, nothing, size, monkeypatch):
    """The chain of neighbours is the same however finely the rows are dealt out."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    rows = fingerprints.with_next(edge, "text", "doc_id").select("doc_id", "text", "next_text").collect()
    tie = {t or "": h & (2**64 - 1) for t, h in spark.createDataFrame([(t or "",) for _, t, _ in EDGE_ROWS], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(((i, t or "") for i, t, _ in EDGE_ROWS), key=lambda x: (x[0] is None, -(x[0] or 0), -tie[x[1]], x[1]))
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert fingerprints.with_next(nothing, "text", "doc_id").count() == 0


def test_rows_of_one_id_are_dealt_out(spark, monkeypatch):
    """Rows without an id, or of one id, make one chain over many ranges."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    ids = [None] * 150 + [5] * 150 + list(range(10, 60))
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("__key"), F.xxhash64("text").alias("__tie"), "text")
    sizes = rows.groupBy(fingerprints._ranges(rows, F.octet_length("text") + 8).alias("n")).count()
    assert sizes.agg(F.max("count")).first()[0] < 60
    following = dict(map(tuple, fingerprints.with_next(docs, "text", "doc_id").select("text", "next_text").collect()))
    seen, at = set(), "text 0"
    while at not in seen:
        seen.add(at)
        at = following[at]
    assert len(seen) == len(ids)


def test_one_row_is_its_own_next(spark):
    row = fingerprints.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert (row["edited_text"], row["near_next"]) == ("abcabc", 1.0)


def test_edge_rows(spark, edge, nothing):
    rows = fingerprints.fingerprint_edits(edge).collect()
    texts = [t or "" for _, t, _ in EDGE_ROWS]
    assert sorted(r["fingerprint"] for r in rows) == sorted(brute.op1_tree(t)[0] for t in texts)
    assert sorted(r["edited_fingerprint"] for r in rows) == sorted(brute.op1_tree(r["edited_text"])[0] for r in rows)
    assert fingerprints.fingerprint_edits(nothing).count() == 0

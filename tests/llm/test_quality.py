"""Quality rules against plain Python."""

import pytest

from tabwright.llm import quality, queries
from tests.llm import brute
from tests.llm.conftest import EDGE_ROWS

SF = "/root/testdata/sf0.001"


def verdicts(rows, rules=quality.QualityRules()):
    """rows: (text, host) -> kept, by the definitions."""
    facts, hosts = [], {}
    for text, host in rows:
        n, chars, symbols, dup, _, hard = brute.op9(text)
        lines = sum(1 for x in (text or "").split("\n") if x.split())
        soft = symbols > 0.5 * n or 100 * dup > 30 * lines or chars < 2 * n or chars > 20 * n
        facts.append((hard, soft, host))
        hosts.setdefault(host, []).append(hard or soft)
    rates = {h: sum(f) / len(f) for h, f in hosts.items()}
    mean = sum(rates.values()) / len(rates)
    variance = sum((r - mean) ** 2 for r in rates.values()) / len(rates)
    bad = set()
    if variance > 1e-12:
        weight = max(0, mean * (1 - mean) / variance - 1)
        for h, f in hosts.items():
            n = len(f) - 1 + weight
            rate = (max(0, sum(f) - 1) + mean * weight) / n if n else mean
            if rate >= 1 or rate > 0 and (rate - mean) / (rate * (1 - rate) / (n + 1)) ** 0.5 > rules.host_deviations:
                bad.add(h)
    return [not hard and not (soft and host in bad) for hard, soft, host in facts]


def test_op9_equals_brute_force(spark, small):
    import duckdb

    sources = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SF}/documents.parquet'").fetchall())
    kept = verdicts([(t, sources[i]) for i, t in small])
    want = {i: (*brute.op9(t), k) for (i, t), k in zip(small, kept, strict=True)}
    assert {r[0]: tuple(r)[1:] for r in queries.op9_quality(spark, SF).collect()} == want


def test_host_verdicts_reach_documents(spark):
    """Without the hosts' verdicts the registered query's rows differ."""
    import dataclasses

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with_hosts = quality.quality_report(docs)
    without = quality.quality_report(docs, rules=dataclasses.replace(quality.QualityRules(), host_deviations=float("inf")))
    rejected = with_hosts.filter("NOT kept AND NOT base_failed")
    assert without.filter("NOT kept AND NOT base_failed").count() == 0 < rejected.count()
    assert rejected.filter("NOT soft_failed").count() == 0


def test_edge_rows(spark, edge, nothing):
    got = sorted((tuple(r) for r in quality.quality_report(edge).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=str)
    kept = verdicts([(t, s) for _, t, s in EDGE_ROWS])
    want = sorted(((i, *brute.op9(t), k) for (i, t, _), k in zip(EDGE_ROWS, kept, strict=True)), key=str)
    assert got == want
    assert quality.quality_report(nothing).count() == 0


def test_keep_good_keeps_columns(spark, edge, nothing):
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns and quality.keep_good(nothing).count() == 0
    want = [i for (i, t, s), k in zip(EDGE_ROWS, verdicts([(t, s) for _, t, s in EDGE_ROWS]), strict=True) if k]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_bad_hosts_lose_soft_failures_only(spark):
    clean = "these are a good many clean words that say something of their own here number {}"
    symbols = "# $ % & | < > * # $ % ok ok ok ok number {} and words that follow # $ % & * # $ %"
    rows = [(i, symbols.format(i), "bad") for i in range(40)] + [(100 + i, clean.format(i), "bad") for i in range(4)]
    rows += [(200 + i, clean.format(i), f"good{i % 5}") for i in range(50)] + [(300, symbols.format(0), "good0")]
    report = quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in report.collect()}
    assert not any(kept[i] for i in range(40)) and all(kept[i] for i in kept if i >= 100)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 2000])
def test_repeats_of_one_word(spark, n):
    text = " ".join(["word"] * n)
    row = quality.quality_report(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert row["n_repeat_words"] == brute.op9(text)[4]

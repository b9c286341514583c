"""URL filters and shards against plain Python, and both queries with SQL."""

import datetime as dt
import random
import zlib

import duckdb
import pytest

from tabwright.llm import queries, sharding, url_filters
from tests.llm.conftest import EDGE_ROWS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_equal_their_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    found = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    names = sorted(found.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == names
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=key) == sorted(want.select(*names).fetchall(), key=key)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute_filter(url, at, events):
    """(n_active, entry, action, valid_from) of one capture."""
    import re

    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    if not m or at is None:
        return 0, None, None, None
    host = m[1].lower().rstrip(".")
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels))}
    if s := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", url):
        keys.add(f"{host}/{s[1]}")
    active = []
    for key in keys:
        history = {}
        for e, a, d in sorted(x for x in events if x[0] and x[1] and x[2]):
            if e.lower() == key and d <= at:
                history[d] = max(a, history.get(d, ""))
        if history and history[max(history)] in ("block", "allow"):
            active.append((len(key), key, history[max(history)], max(history)))
    return (len(active), *max(active)[1:]) if active else (0, None, None, None)


def test_filter_urls(spark):
    rng = random.Random(6)
    hosts = ["a.example.org", "b.a.example.org", "Example.org", "x.example.com", "example.com.", "user:pw@a.example.org:80", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/de?x=/en", "?q", "#f")] + [None, "no url", "mailto:x@example.org", "http://"]
    captures = [(i, rng.choice(urls), rng.choice([None, *map(day, range(0, 60, 3))])) for i in range(500)]
    entries = ["example.org", "a.example.org", "org", "a.example.org/en", "x.example.com", "EXAMPLE.com", "", None]
    events = [(rng.choice(entries), rng.choice(["block", "allow", "remove", None]), rng.choice([None, *map(day, range(0, 60, 2))])) for _ in range(60)]
    events = sorted(set(events), key=str)
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at date").selectExpr("*", "'own' AS entry", "'own' AS blocked")
    e = spark.createDataFrame(events, "entry string, action string, since date")
    got = {r["page_id"]: (r["n_active"], r["entry"], r["action"], r["valid_from"], r["blocked"]) for r in url_filters.filter_urls(c, e).collect()}
    want = {i: brute_filter(u, t, events) for i, u, t in captures}
    assert got == {i: (*w, w[2] == "block") for i, w in want.items()}
    assert len({w[1] for w in want.values()}) > 4
    assert url_filters.filter_urls(c, e.limit(0)).filter("blocked OR n_active > 0").count() == 0
    assert url_filters.filter_urls(c.limit(0), e).count() == 0


def check_shards(rows, shards):
    """rows: (source, shard, slot)."""
    total, mixture = {}, {}
    for source, shard, slot in rows:
        total.setdefault(shard, []).append(slot)
        mixture.setdefault(source, {}).setdefault(shard, 0)
        mixture[source][shard] += 1
    sizes = [len(total.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(x) == list(range(len(x))) for x in total.values())
    for counts in mixture.values():
        found = [counts.get(s, 0) for s in range(shards)]
        assert max(found) - min(found) <= 2


def test_op10(spark, small):
    rows = queries.op10_sharding(spark, SF).collect()
    texts = dict(small)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    check_shards([(r["source"], r["shard"], r["slot"]) for r in rows], 8)


def test_edge_rows(spark, edge, nothing):
    rows = sharding.document_shards(edge, shards=4).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 1) for i, t, _ in EDGE_ROWS)
    check_shards([(r["source"], r["shard"], r["slot"]) for r in rows], 4)
    assert sharding.document_shards(nothing).count() == 0
    kept = sharding.proportional_shards(edge.select("doc_id", "source", "key"), "source", ["doc_id"], 3)
    assert kept.columns == ["doc_id", "source", "key", "shard", "slot", "fraction"]


def test_a_hot_source_and_the_seed(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 9}") for i in range(999)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(7)
    placed = {seed: {r["doc_id"]: (r["source"], r["shard"], r["slot"]) for r in sharding.proportional_shards(docs, "source", ["doc_id"], 8, seed).collect()} for seed in (1, 2)}
    for found in placed.values():
        check_shards(list(found.values()), 8)
    again = {r["doc_id"]: (r["source"], r["shard"], r["slot"]) for r in sharding.proportional_shards(docs.repartition(3), "source", ["doc_id"], 8, 1).collect()}
    assert again == placed[1] != placed[2]

"""Spaced identifiers, digit-free hex runs and deep paths of URL lists."""

import datetime as dt
import random

from tabwright.llm import pii, secrets, url_filters
from tabwright.llm.spans import digest_of


def spans(found):
    return {r["doc_id"]: r["s"] for r in found.select("doc_id", digest_of(found["spans"]).alias("s")).collect()}


def test_spaced_numbers_teach_and_are_found(spark):
    rng = random.Random(3)
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = [(i, f"please call me on +1 ({d(3)}) {d(3)}-{d(4)} today") for i in range(40)]
    rows += [(100, "please call me on (017) 555-7713 today"), (101, "please call me on 555 123 4567, today"), (102, "there are 555 123 4567 of them")]
    got = spans(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[100], got[101], got[102]) == ("phone:18:32", "phone:18:30", "")
    assert all(got[i] == "phone:18:35" for i in range(40))


def test_hex_runs_without_digits(spark):
    rows = [(1, "x " + "a" * 30), (2, "deadbeef" * 3), (3, "a" * 23)]
    got = spans(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {1: "hex:2:32", 2: "hex:0:24", 3: ""}


def test_deep_paths_and_their_case(spark):
    day = dt.date(2024, 1, 1)
    events = spark.createDataFrame([(e, "block", day) for e in ("Example.org/a/b", "example.org/Up", "example.org/low")], "entry string, action string, since date")
    urls = ["http://example.org/a/b/c?d", "http://example.org/a", "http://EXAMPLE.org/Up/x", "http://example.org/up", "http://example.org/low", "http://example.org/LOW", "http://example.org/a/bc"]
    rows = [(i, u, day) for i, u in enumerate(urls)]
    got = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched_at date"), events)
    assert {r["page_id"]: r["entry"] for r in got.collect()} == dict(enumerate(["example.org/a/b", None, "example.org/Up", None, "example.org/low", None, None]))

import math

import pytest

from tabwright.frame import Frame
from tabwright.functions.aggregates import AggFunc
from tabwright.operators.grouping import GroupByOptions

ROWS = [(1, "a", 1, 1.0), (2, "a", 2, None), (3, "a", 3, 3.0), (4, "b", 4, None), (5, None, 5, 5.0)]


@pytest.fixture(scope="module")
def groups(spark):
    return Frame.from_rows(spark, ROWS, "id int, k string, i int, x double")


EXPECTED = {
    AggFunc.SUM: (4.0, None, 5.0),
    AggFunc.MEAN: (2.0, None, 5.0),
    AggFunc.MIN: (1.0, None, 5.0),
    AggFunc.MAX: (3.0, None, 5.0),
    AggFunc.PROD: (3.0, None, 5.0),
    AggFunc.MEDIAN: (2.0, None, 5.0),
    AggFunc.VAR: (2.0, None, None),
    AggFunc.STD: (math.sqrt(2), None, None),
    AggFunc.COUNT: (2, 0, 1),
    AggFunc.NUNIQUE: (2.0, 0.0, 1.0),
    AggFunc.FIRST: (1.0, None, 5.0),
    AggFunc.LAST: (3.0, None, 5.0),
}


@pytest.mark.parametrize("func", list(AggFunc))
def test_aggregates(groups, func):
    found = {r["k"]: r["x"] for r in groups.group_by("k").agg({"x": func}).to_spark().collect()}
    want = dict(zip(("a", "b", None), EXPECTED[func], strict=True))
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == v if v is None else found[k] == pytest.approx(v)


@pytest.mark.parametrize("func", list(AggFunc))
@pytest.mark.parametrize("window", [False, True])
def test_transform_keeps_rows(groups, func, window):
    got = groups.group_by("k").transform("x", func, window=window)
    name = f"x_{func.value}"
    values = [r[name] for r in got.data.orderBy("id").collect()]
    a, b, none = EXPECTED[func]
    assert [None if v is None else pytest.approx(v) for v in (a, a, a, b, none)] == values
    assert got.column_names == ["id", "k", "i", "x", name]


def test_counts(groups):
    g = groups.group_by("K")
    assert {(r["k"], r["count"]) for r in g.count().to_spark().collect()} == {("a", 3.0), ("b", 1.0), (None, 1.0)}
    assert g.group_count() == 3
    sizes = groups.group_by("k", "i", options=GroupByOptions("/")).group_sizes().to_spark().collect()
    assert {r["group"] for r in sizes} == {"a/1", "a/2", "a/3", "b/4", "\0null/5"}


def test_filters(groups):
    def ids(frame):
        return sorted(r["id"] for r in frame.to_spark().collect())

    assert ids(groups.group_by("k").filter({"x": (AggFunc.SUM, lambda s: s > 3)})) == [1, 2, 3, 5]
    assert ids(groups.group_by("k").filter(lambda rows: len(rows) == 3)) == [1, 2, 3]
    assert ids(groups.group_by("k").filter(lambda rows: True)) == [1, 2, 3, 4, 5]
    empty = groups.group_by("k").filter(lambda rows: False)
    assert ids(empty) == [] and empty.column_names == ["id", "k", "i", "x"]
    assert ids(groups.group_by("k").filter_size(lambda n: n > 1)) == [1, 2, 3]


def test_apply(groups):
    shares = groups.group_by("k").apply(lambda rows: None if rows["k"].isna().any() else rows.assign(i=rows["i"] * 2))
    assert sorted((r["id"], r["i"]) for r in shares.to_spark().collect()) == [(1, 2), (2, 4), (3, 6), (4, 8)]


def test_keys(groups):
    both = groups.group_by("k").agg({"k": AggFunc.COUNT, "x": AggFunc.MAX})
    assert both.column_names == ["k", "x"]
    assert {r["k"] for r in both.to_spark().collect()} == {3, 1, 0}
    text = groups.group_by("i", options=GroupByOptions(keys_as_string=True)).agg({"x": AggFunc.SUM})
    assert {r["i"] for r in text.to_spark().collect()} == {"1", "2", "3", "4", "5"}


def test_errors(groups, spark):
    with pytest.raises(ValueError):
        groups.group_by()
    with pytest.raises(KeyError):
        groups.group_by("nope")
    with pytest.raises(ValueError):
        groups.group_by("k").agg({})
    with pytest.raises(TypeError):
        groups.group_by("i").agg({"k": AggFunc.SUM})
    with pytest.raises(ValueError):
        GroupByOptions("")
    bare = Frame(spark.createDataFrame(ROWS, "id int, k string, i int, x double"))
    with pytest.raises(ValueError):
        bare.group_by("k").agg({"x": AggFunc.FIRST})


def test_min_and_max_pass_over_nan(spark):
    f = Frame.from_rows(spark, [("a", float("nan")), ("a", 2.0), ("b", float("nan"))], "k string, x double")
    assert {r["k"]: r["x"] for r in f.group_by("k").agg({"x": AggFunc.MAX}).to_spark().collect()} == {"a": 2.0, "b": None}

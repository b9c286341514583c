import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabwright.frame import Frame
from tabwright.functions import masks

NAN = float("nan")
ROWS = [(1, "a", 1.0, "Madrid"), (2, "a", None, None), (3, "a", NAN, "Madrid"), (4, "b", None, ""), (5, None, 5.0, "Roma")]


@pytest.fixture(scope="module")
def nulls(spark):
    return Frame.from_rows(spark, ROWS, "id int, k string, x double, s string")


def ids(frame, mask):
    return sorted(r[0] for r in frame.where(mask).select("id").to_spark().collect())


def total_ids(frame, mask):
    """By the mask as a value, which must select the same rows as the filter."""
    return sorted(r["id"] for r in frame.data.select("id", mask.total.alias("m")).collect() if r["m"])


CASES = [
    (lambda f: f["x"].greater_than(2.0), [5]),
    (lambda f: f["x"].greater_than_or_equal(5.0), [5]),
    (lambda f: f["x"].less_than(2.0), [1, 3]),
    (lambda f: f["x"].less_than_or_equal(1.0), [1, 3]),
    (lambda f: f["x"].equal_to(1.0), [1]),
    (lambda f: f["x"].not_equal_to(1.0), [3, 5]),
    (lambda f: f["x"].between(1.0, 5.0), [1, 5]),
    (lambda f: f["x"].between(NAN, 1.0), [1, 3]),
    (lambda f: f["x"].is_null(), [2, 4]),
    (lambda f: f["x"].is_not_null(), [1, 3, 5]),
    (lambda f: f["x"].greater_than(NAN), [1, 5]),
    (lambda f: f["x"].greater_than_or_equal(NAN), [1, 3, 5]),
    (lambda f: f["x"].less_than(NAN), []),
    (lambda f: f["x"].less_than_or_equal(NAN), [3]),
    (lambda f: f["x"].equal_to(NAN), [3]),
    (lambda f: f["x"].not_equal_to(NAN), [1, 5]),
    (lambda f: ~f["x"].greater_than(2.0), [1, 2, 3, 4]),
    (lambda f: f["x"].greater_than(2.0) ^ f["s"].equals("Madrid"), [1, 3, 5]),
    (lambda f: f["x"].greater_than(0.0) & f["s"].equals("Madrid"), [1]),
    (lambda f: f["x"].greater_than(2.0) | f["s"].equals(None), [2, 5]),
    (lambda f: f["s"].equals(None), [2]),
    (lambda f: f["s"].equals(""), [4]),
    (lambda f: f["s"].is_in("Madrid", None), [1, 3]),
    (lambda f: f["s"].is_in(), []),
    (lambda f: f["s"].is_in_categories("Madrid", None), [1, 2, 3]),
    (lambda f: masks.all_(f["id"].greater_than(1), f["id"].less_than(4)), [2, 3]),
    (lambda f: masks.any_(f["id"].equal_to(1), f["id"].equal_to(4)), [1, 4]),
]


@pytest.mark.parametrize(("make", "expected"), CASES)
def test_predicates(nulls, make, expected):
    assert ids(nulls, make(nulls)) == expected
    assert total_ids(nulls, make(nulls)) == expected


def test_counts_and_positions(nulls):
    mask = nulls["id"].greater_than(2)
    assert nulls.count_true(mask) == 3
    assert [r[0] for r in nulls.true_positions(mask).collect()] == [2, 3, 4]


def test_errors(nulls):
    with pytest.raises(ValueError):
        masks.all_()
    with pytest.raises(ValueError):
        masks.any_()
    with pytest.raises(ValueError):
        nulls["x"].between(2.0, 1.0)
    with pytest.raises(TypeError):
        bool(nulls["x"].is_null())


def test_pushed_to_the_scan(spark):
    frame = Frame.read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = frame.where(frame["l_quantity"].greater_than(45.0) & frame["l_returnflag"].equals("R")).select("l_orderkey").to_spark()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in text and "EqualTo(l_returnflag,R)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in text


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells=st.lists(st.one_of(st.none(), st.floats(allow_infinity=False)), max_size=8), value=st.floats(allow_nan=False, allow_infinity=False))
def test_not_is_an_involution_and_a_complement(spark, cells, value):
    frame = Frame.from_rows(spark, list(enumerate(cells)), "id int, x double")
    mask = frame["x"].less_than(value)
    expected = [i for i, c in enumerate(cells) if c is not None and (math.isnan(c) or c < value)]
    assert ids(frame, mask) == ids(frame, ~~mask) == expected
    assert len(ids(frame, mask)) + len(ids(frame, ~mask)) == len(cells)

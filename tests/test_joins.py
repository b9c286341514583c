import pytest

from tabwright.frame import Frame


@pytest.fixture(scope="module")
def sides(spark):
    left = Frame.from_rows(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "k string, v int")
    right = Frame.from_rows(spark, [("a", 10), ("a", 20), (None, 30), ("d", 40)], "k string, v int")
    return left, right


def rows(frame):
    return sorted((tuple(r) for r in frame.to_spark().collect()), key=str)


INNER = [("a", 1, 10), ("a", 1, 20), ("a", 2, 10), ("a", 2, 20)]
LEFT = [("b", 3, None), (None, 4, None), ("c", 5, None)]
RIGHT = [(None, None, 30), ("d", None, 40)]


@pytest.mark.parametrize(("how", "expected"), [("inner", INNER), ("left", INNER + LEFT), ("right", INNER + RIGHT), ("outer", INNER + LEFT + RIGHT)])
def test_kinds(sides, how, expected):
    joined = sides[0].merge(sides[1], on="k", how=how)
    assert joined.column_names == ["k", "v_x", "v_y"]
    assert rows(joined) == sorted(expected, key=str)


def test_different_names_and_parts(spark):
    left = Frame.from_rows(spark, [(1, "x", 1.0), (1, None, 2.0)], "a int, b string, l double")
    right = Frame.from_rows(spark, [(1, "x", 3.0), (1, None, 4.0)], "c bigint, d string, r double")
    joined = left.merge(right, left_on=["a", "b"], right_on=["c", "d"], how="outer")
    assert joined.column_names == ["a", "b", "l", "r"]
    assert rows(joined) == sorted([(1, "x", 1.0, 3.0), (1, None, 2.0, None), (1, None, None, 4.0)], key=str)


def test_errors(sides, spark):
    left, right = sides
    with pytest.raises(ValueError):
        left.merge(right, left_on=["k"], right_on=["k", "v"])
    with pytest.raises(ValueError):
        left.merge(right, on="nope")
    with pytest.raises(ValueError):
        left.merge(right, left_on=[], right_on=[])
    with pytest.raises(TypeError):
        left.merge(Frame.from_rows(spark, [(1.0,)], "v double"), on="v")
    clash = Frame.from_rows(spark, [("a", 1)], "z string, k int")
    with pytest.raises(ValueError):
        left.merge(clash, left_on=["k"], right_on=["z"])


def test_inner_within_left_within_outer(sides):
    found = {how: set(rows(sides[0].merge(sides[1], on="k", how=how))) for how in ("inner", "left", "outer")}
    assert found["inner"] < found["left"] < found["outer"]

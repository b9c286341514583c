import pytest
from pyspark.sql import types as T

from tabwright.frame import Frame
from tabwright.functions import categorical
from tabwright.functions.aggregates import AggFunc


@pytest.fixture(scope="module")
def shop(spark):
    return Frame.from_columns(spark, [("price", "double", [10.5, 20.0, 15.75]), ("sold", "int", [120, 340, 85]), ("city", "string", ["Madrid", "Barcelona", "Sevilla"])])


def rows(frame):
    return [tuple(r) for r in frame.to_spark().collect()]


def test_columns(shop):
    assert shop.column_names == ["price", "sold", "city"] and shop.column_count == 3 and shop.row_count() == 3
    assert shop.select("CITY", "price", "city").column_names == ["city", "price"]
    assert shop[1].name == "sold" and shop["SOLD"].kind == T.IntegerType()
    assert shop.contains_column("City") and not shop.contains_column("x")
    with pytest.raises(KeyError):
        shop.select("x")
    with pytest.raises(ValueError):
        shop.select()
    with pytest.raises(IndexError):
        shop[3]
    with pytest.raises(TypeError):
        shop.column("sold", T.DoubleType())
    smaller, removed = shop.try_remove_column("SOLD")
    assert removed and smaller.column_names == ["price", "city"]
    assert shop.try_remove_column("x") == (shop, False)


def test_add_column_replaces_in_place(shop):
    doubled = shop.add_column(shop["price"].multiply(2).renamed("PRICE"))
    assert doubled.column_names == ["price", "sold", "city"]
    assert [r[0] for r in rows(doubled)] == [21.0, 40.0, 31.5]


def test_construction_errors(spark):
    with pytest.raises(ValueError):
        Frame.from_columns(spark, [("a", "int", [1]), ("b", "int", [1, 2])])
    with pytest.raises(ValueError):
        Frame.from_columns(spark, [("a", "int", None)])
    twice = Frame.from_columns(spark, [("a", "int", [1]), ("b", "int", [2]), ("A", "int", [3])])
    assert rows(twice) == [(3, 2)]


def test_head_and_tail(shop):
    assert [r[2] for r in rows(shop.head(2))] == ["Madrid", "Barcelona"]
    assert [r[2] for r in rows(shop.tail(2))] == ["Barcelona", "Sevilla"]
    assert shop.row_at(1) == (20.0, 340, "Barcelona")
    assert [r[2] for r in rows(shop.ordered_by("sold").head(1))] == ["Sevilla"]
    with pytest.raises(ValueError):
        shop.head(0)


def test_arithmetic(spark):
    f = Frame.from_rows(spark, [(7, 2, 7.0, 2.0), (1, 0, 1.0, 0.0), (None, 3, None, 3.0), (2147483647, 1, 1.0, -0.0)], "a int, b int, p double, q double")

    def values(series):
        return [r[0] for r in f.data.orderBy("__tabwright_pos").select(series.expr).collect()]

    assert values(f["a"] / f["b"]) == [3.5, None, None, 2147483647.0]
    assert values(f["a"] + f["b"]) == [9, 1, None, -2147483648]
    assert values(f["a"] * f["a"]) == [49, 1, None, 1]
    assert values(f["a"] - f["b"]) == [5, 1, None, 2147483646]
    assert values(f["p"] / f["q"]) == [3.5, None, None, None]
    assert values(f["a"].add(1)) == [8, 2, None, -2147483648]
    assert (f["a"] + f["b"]).name == "a+b" and f["p"].multiply(2).name == "p"
    with pytest.raises(ZeroDivisionError):
        f["p"].divide(0)
    with pytest.raises(TypeError):
        f["a"] + f["p"]
    with pytest.raises(TypeError):
        f["a"].add(1.5)


def test_reductions(spark):
    f = Frame.from_rows(spark, [(1.0, None), (float("nan"), None), (3.0, None)], "x double, e double")
    assert f.reduction("x", "min") == 1.0 and f.reduction("x", "max") == 3.0 and f.reduction("x", "count") == 3
    assert str(f.reduction("e", "sum")) == "nan" and f.reduction("e", "count") == 0 and str(f.reduction("e", "std")) == "nan"


def test_categorical(spark):
    f = Frame.from_rows(spark, [(c,) for c in ["ES", "FR", "ES", "DE", None, "FR", "ES"]], "country string")
    c = categorical.to_categorical(f, "country")
    assert categorical.categories(c, "country") == ["ES", "FR", "DE"] and c.is_categorical("COUNTRY")
    coded = categorical.with_codes(c, "country")
    assert [r["code"] for r in coded.data.orderBy("__tabwright_pos").collect()] == [0, 1, 0, 2, -1, 1, 0]
    kept = c.where(c["country"].equals("FR"))
    assert {(r["value"], r["count"]) for r in categorical.value_counts(kept, "country").collect()} == {("ES", 0), ("FR", 2), ("DE", 0)}
    assert categorical.cardinality_ratio(c, "country") == 3 / 7
    assert categorical.try_get_code(c, "country", None) == (True, -1)
    assert categorical.try_get_code(c, "country", "XX") == (False, -1)
    assert categorical.decode_category(c, "country", 1) == "FR" and categorical.decode_category(c, "country", -1) is None
    assert not categorical.to_string(c, "country").is_categorical("country")
    with pytest.raises(TypeError):
        c.string_column("country")
    with pytest.raises(IndexError):
        categorical.decode_category(c, "country", 3)


def test_display(spark):
    f = Frame.from_rows(spark, [(f"city number {i}", None if i == 3 else i + 0.5, i) for i in range(11)], "city string, price double, n int")
    lines = f.display_string().split("\n")
    assert lines[0] == "       " + "city          price  n" .replace("price  n", "price    n") or lines[0].startswith("       city")
    assert set(lines[1]) == {"─"} and len(lines[1]) == len(lines[2])
    assert lines[7].strip().startswith("...") and len(lines) == 2 + 11 + 2 + 1 + 3 + 1
    assert "city number…" in lines[2] and "0.5" in lines[2] and "NaN" in lines[5]
    assert "[11 rows × 3 columns]" in lines and "  price: float64" in lines and "  n: int32" in lines and "  city: object" in lines
    one = Frame.from_rows(spark, [(20.0, True)], "x double, b boolean").display_string()
    assert "20.00" in one and "True" in one
    assert Frame.from_rows(spark, [], "a int").display_string() == "Empty DataFrame\nColumns: [a]\n[0 rows × 1 columns]"


def test_order_survives_narrowing(spark):
    f = Frame(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, t string"), ["n"])
    assert rows(f.select("t").head(2)) == [("a",), ("b",)]
    assert f.group_by("t").agg({"n": AggFunc.FIRST}).row_count() == 3


def test_names_with_dots_and_underscores(spark, tmp_path):
    from tabwright.sources.csv import load_csv, write_csv
    from tabwright.sources.excel import load_excel, write_excel
    from tabwright.sources.json import load_json, write_json
    from tabwright.sources.options import JsonOrientation

    data = spark.createDataFrame([(2, "x", 1.5, 7), (1, "y", 2.5, 8), (3, "x", 3.5, 9)], "`a.b` int, `k.1` string, `v``q` double, __index_level_0__ int")
    f = Frame.over(data, ["a.b"])
    assert f.column_names == ["a.b", "k.1", "v`q", "__index_level_0__"]
    assert rows(f.head(1)) == [(1, "y", 2.5, 8)]
    g = f.group_by("k.1")
    assert sorted(rows(g.agg({"v`q": AggFunc.SUM, "a.b": AggFunc.FIRST}))) == [("x", 5.0, 2.0), ("y", 2.5, 1.0)]
    assert sorted(rows(g.count())) == [("x", 2.0), ("y", 1.0)] and g.group_count() == 2
    assert sorted(rows(g.group_sizes())) == [("x", 2), ("y", 1)]
    assert sorted(r[4] for r in rows(g.transform("v`q", AggFunc.MAX))) == [2.5, 3.5, 3.5]
    assert sorted(r[0] for r in rows(g.filter({"v`q": (AggFunc.SUM, lambda x: x > 3)}))) == [2, 3]
    assert sorted(r[0] for r in rows(f.merge(f.select("k.1", "a.b"), on="k.1").select("a.b_x"))) == [1, 2, 2, 3, 3]
    c = categorical.to_categorical(f, "k.1")
    assert categorical.categories(c, "k.1") == ["y", "x"]
    assert sorted(r[4] for r in rows(categorical.with_codes(c, "k.1"))) == [0, 1, 1]
    write_csv(f, str(tmp_path / "f.csv"))
    assert load_csv(spark, str(tmp_path / "f.csv")).column_names == f.column_names
    write_json(f, str(tmp_path / "f.json"), JsonOrientation.SPLIT)
    assert load_json(spark, str(tmp_path / "f.json")).column_names == f.column_names
    write_excel(f, str(tmp_path / "f.xlsx"))
    assert load_excel(spark, str(tmp_path / "f.xlsx"), sheet="Sheet1").column_names == f.column_names
    with pytest.raises(ValueError):
        load_excel(spark, str(tmp_path / "f.xlsx"), sheet="other")
    assert "__index_level_0__" in f.display_string()
    with pytest.raises(ValueError):
        Frame.over(spark.createDataFrame([(1,)], "__tabwright_pos int"))


def test_orders_of_groups_and_joins(spark):
    f = Frame.from_rows(spark, [("b", 1), ("a", 2), ("b", 3), (None, 4), ("a", 5)], "k string, n int")
    g = f.group_by("k")
    assert rows(g.agg({"n": AggFunc.SUM}, ordered=True).head(9)) == [("b", 4.0), ("a", 7.0), (None, 4.0)]
    assert rows(g.count(ordered=True).tail(2)) == [("a", 2.0), (None, 1.0)]
    assert [r[1] for r in rows(g.filter({"n": (AggFunc.SUM, lambda x: x > 0)}, regrouped=True).head(9))] == [1, 3, 2, 5, 4]
    right = Frame.from_rows(spark, [("c", 10), ("a", 20), ("d", 30), ("a", 40)], "k string, m int")
    joined = f.merge(right, on="k", how="outer", ordered=True)
    assert rows(joined.head(20)) == [("b", 1, None), ("a", 2, 20), ("a", 2, 40), ("b", 3, None), (None, 4, None), ("a", 5, 20), ("a", 5, 40), ("c", None, 10), ("d", None, 30)]
    assert rows(joined.group_by("k").agg({"m": AggFunc.LAST}).where(joined["k"].equals("a"))) == [("a", 40.0)]
    with pytest.raises(ValueError):
        f.merge(Frame(spark.range(1).selectExpr("'a' AS k")), on="k", ordered=True)


def test_large_dictionaries_are_tables(spark, monkeypatch):
    monkeypatch.setattr(categorical, "MOST_LISTED", 3)
    f = Frame.from_rows(spark, [(v,) for v in ["e", "a", None, "d", "a", "b", "e", "c"]], "v string")
    c = categorical.to_categorical(f, "v")
    assert c.is_categorical("v") and categorical.category_count(c, "v") == 5
    assert [tuple(r) for r in categorical.category_table(c, "v").orderBy("code").collect()] == list(enumerate("eadbc"))
    assert [r["code"] for r in categorical.with_codes(c, "v").data.orderBy("__tabwright_pos").collect()] == [0, 1, -1, 2, 1, 3, 0, 4]
    assert categorical.try_get_code(c, "v", "d") == (True, 2) and categorical.try_get_code(c, "v", "x") == (False, -1)
    assert categorical.decode_category(c, "v", 4) == "c" and categorical.cardinality_ratio(c, "v") == 5 / 8
    assert {tuple(r) for r in categorical.value_counts(c.where(c["v"].equals("a")), "v").collect()} == {("a", 2), ("b", 0), ("c", 0), ("d", 0), ("e", 0)}
    with pytest.raises(ValueError):
        categorical.categories(c, "v")

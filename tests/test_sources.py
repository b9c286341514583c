import datetime as dt
import zipfile

import pytest

from tabwright.frame import Frame
from tabwright.sources.csv import load_csv, normalize_headers, write_csv
from tabwright.sources.excel import column_index, column_letters, load_excel, write_excel
from tabwright.sources.json import InvalidJson, load_json, write_json
from tabwright.sources.options import CsvOptions, ExcelOptions, JsonOptions, JsonOrientation, LoadOptions


def rows(frame):
    return [tuple(r) for r in frame.to_spark().collect()]


def types(frame):
    return [frame.type_of(n).simpleString() + ("*" if frame.is_categorical(n) else "") for n in frame.column_names]


def put(tmp_path, text, name="in.txt"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


NO_CATEGORIES = LoadOptions(categorical_threshold=1.0)


def test_headers():
    assert normalize_headers([" id ", "", "ID", None, "id"]) == ["id", "Column1", "ID_1", "Column3", "id_2"]


def test_csv_plain(spark, tmp_path):
    f = load_csv(spark, put(tmp_path, "a,b\n1,2\n"))
    assert f.column_names == ["a", "b"] and rows(f) == [(1, 2)] and types(f) == ["int", "int"]


def test_csv_ragged_quotes_blanks_bom(spark, tmp_path):
    text = '﻿a,b,c\n1\n   \n1,2,3,4,5\n"x,y","a""b",\n'
    f = load_csv(spark, put(tmp_path, text), NO_CATEGORIES)
    assert f.column_names == ["a", "b", "c"]
    assert rows(f) == [("1", None, None), ("1", "2", 3), ("x,y", 'a"b', None)]


def test_csv_rows_of_empty_fields_stay(spark, tmp_path):
    assert rows(load_csv(spark, put(tmp_path, "a,b\n1,2\n,\n \t \n3,4\n"))) == [(1, 2), (None, None), (3, 4)]
    assert rows(load_csv(spark, put(tmp_path, "a\n1\n   \n2\n"))) == [(1,), (2,)]


def test_csv_folder_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text(f"a,b\n{i},x\n")
    assert sorted(rows(load_csv(spark, str(tmp_path), NO_CATEGORIES))) == [(0, "x"), (1, "x"), (2, "x")]


def test_csv_options(spark, tmp_path):
    assert rows(load_csv(spark, put(tmp_path, "a;b\n1;x\n"), CsvOptions.european())) == [(1, "x")]
    assert rows(load_csv(spark, put(tmp_path, "a\tb\n1\tx\n"), CsvOptions.tab())) == [(1, "x")]
    f = load_csv(spark, put(tmp_path, "1,x\n2,\n"), CsvOptions(has_header=False, empty_as_null=False))
    assert f.column_names == ["Column0", "Column1"] and rows(f) == [(1, "x"), (2, "")]
    assert rows(load_csv(spark, put(tmp_path, "a,b\n1,\n"))) == [(1, None)]
    with pytest.raises(ValueError):
        load_csv(spark, put(tmp_path, ""))
    with pytest.raises(ValueError):
        CsvOptions(delimiter='"')
    with pytest.raises(ValueError):
        LoadOptions(categorical_threshold=1.5)


INFERRED = [
    (["1", "2", ""], "int"),
    (["1", "2.5"], "double"),
    (["1.0", "2.0"], "double"),
    (["3000000000"], "double"),
    (["1,234.5"], "double"),
    (["", ""], "int"),
    (["true", "false"], "string"),
    (["2024-01-02", ""], "timestamp_ntz"),
    (["01/31/2024"], "timestamp_ntz"),
    (["2024-01-02", "x"], "string"),
    (["(1)", "2"], "string"),
]


@pytest.mark.parametrize(("cells", "expected"), INFERRED)
def test_csv_inference(spark, tmp_path, cells, expected):
    text = "k,v\n" + "".join(f'{i},"{c}"\n' if c else f"{i},\n" for i, c in enumerate(cells))
    f = load_csv(spark, put(tmp_path, text), NO_CATEGORIES)
    assert types(f)[1] == expected


def test_categorical_threshold(spark, tmp_path):
    path = put(tmp_path, "s\na\na\na\nb\n")
    assert types(load_csv(spark, path, LoadOptions(0.5))) == ["string"]
    assert types(load_csv(spark, path, LoadOptions(0.6))) == ["string*"]
    assert types(load_csv(spark, path, LoadOptions(1.0))) == ["string"]


def test_csv_write(spark, tmp_path):
    f = Frame.from_rows(spark, [(1.5, True, "a,b", dt.datetime(2024, 1, 2)), (float("nan"), False, 'q"', dt.datetime(2024, 1, 2, 3, 4, 5)), (None, None, None, None), (float("inf"), None, "", None)], "x double, b boolean, s string, t timestamp_ntz")
    write_csv(f, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text() == 'x,b,s,t\n1.5,true,"a,b",2024-01-02\n,false,"q""",2024-01-02T03:04:05\n,,,\n,,,\n'


def test_json_records(spark, tmp_path):
    text = '[{"a": 1, "b": "x", "n": {"z": [1, 2]}}, null, {"a": 2.5, "extra": 1}, {"b": null, "a": null}]'
    f = load_json(spark, put(tmp_path, text), NO_CATEGORIES)
    assert f.column_names == ["a", "b", "n"] and types(f) == ["double", "string", "string"]
    assert rows(f) == [(1.0, "x", '{"z":[1,2]}'), (2.5, None, None), (None, None, None)]
    with pytest.raises(InvalidJson):
        load_json(spark, put(tmp_path, "[1, 2]"))
    with pytest.raises(InvalidJson):
        load_json(spark, put(tmp_path, "3"))
    with pytest.raises(InvalidJson):
        load_json(spark, put(tmp_path, "{oops"))


def test_json_types(spark, tmp_path):
    f = load_json(spark, put(tmp_path, '[{"i": 1.0, "t": true, "d": "2024-01-02", "s": "5", "big": 3000000000}, {"i": 2, "t": false, "d": null, "s": "6", "big": 1}]'), NO_CATEGORIES)
    assert types(f) == ["int", "string", "timestamp_ntz", "int", "double"]


def test_json_columns_and_split(spark, tmp_path):
    f = load_json(spark, put(tmp_path, '{"b": [1, 2], "a": ["x", null]}'), NO_CATEGORIES)
    assert f.column_names == ["b", "a"] and rows(f) == [(1, "x"), (2, None)]
    with pytest.raises(InvalidJson):
        load_json(spark, put(tmp_path, '{"a": [1], "b": [1, 2]}'))
    with pytest.raises(InvalidJson):
        load_json(spark, put(tmp_path, '{"a": 1}'))
    s = load_json(spark, put(tmp_path, '{"columns": ["a", null], "data": [[1], [2, "y", 3]]}'), NO_CATEGORIES)
    assert s.column_names == ["a", "Column1"] and rows(s) == [(1, None), (2, "y")]
    with pytest.raises(InvalidJson):
        load_json(spark, put(tmp_path, '{"a": [1]}'), JsonOptions(orientation=JsonOrientation.SPLIT))


def test_json_empty(spark, tmp_path):
    f = load_json(spark, put(tmp_path, '{"columns": ["a"], "data": []}'))
    assert types(f) == ["string"] and rows(f) == []


@pytest.mark.parametrize("orientation", list(JsonOrientation))
@pytest.mark.parametrize("indented", [True, False])
def test_json_round_trip(spark, tmp_path, orientation, indented):
    import json

    f = Frame.from_rows(spark, [(1, 1.5, 'q"é', True), (2, float("nan"), None, None), (3, None, "x", False)], "n int, x double, s string, b boolean")
    path = tmp_path / "o.json"
    write_json(f, str(path), orientation, JsonOptions(indented=indented))
    found = json.loads(path.read_text())
    data = [(1, 1.5, 'q"é', True), (2, None, None, None), (3, None, "x", False)]
    names = ["n", "x", "s", "b"]
    expected = {
        JsonOrientation.RECORDS: [dict(zip(names, r, strict=True)) for r in data],
        JsonOrientation.COLUMNS: {n: [r[i] for r in data] for i, n in enumerate(names)},
        JsonOrientation.SPLIT: {"columns": names, "data": [list(r) for r in data]},
    }[orientation]
    assert found == expected
    back = load_json(spark, str(path), NO_CATEGORIES)
    assert [r[:3] for r in rows(back)] == [r[:3] for r in data]


def test_excel(spark, tmp_path):
    assert [column_letters(i) for i in (0, 25, 26, 701)] == ["A", "Z", "AA", "ZZ"]
    assert [column_index(r) for r in ("A1", "Z9", "AA3", "ZZ1")] == [0, 25, 26, 701]
    with pytest.raises(ValueError):
        column_letters(702)
    f = Frame.from_rows(spark, [(1, 1.5, "a<b&", True, dt.datetime(2024, 1, 2)), (2, float("inf"), None, False, None), (None, None, "z", None, None)], "n int, x double, s string, b boolean, t timestamp_ntz")
    write_excel(f, str(tmp_path / "book"), ExcelOptions("My sheet"))
    with zipfile.ZipFile(tmp_path / "book.xlsx") as book:
        assert 'name="My sheet"' in book.read("xl/workbook.xml").decode()
    back = load_excel(spark, str(tmp_path / "book.xlsx"), NO_CATEGORIES)
    assert rows(back) == [(1, 1.5, "a<b&", "TRUE", dt.datetime(2024, 1, 2)), (2, None, None, "FALSE", None), (None, None, "z", None, None)]
    with pytest.raises(ValueError):
        load_excel(spark, "old.xls")


def test_loaders(spark, tmp_path):
    from tabwright.sources.loaders import LOADERS, CsvLoader, Loader, load

    assert all(isinstance(x, Loader) for x in LOADERS.values()) and isinstance(CsvLoader(), Loader)
    assert rows(load(spark, put(tmp_path, "a\n1\n", "x.csv"))) == [(1,)]
    frame = load(spark, put(tmp_path, '[{"a": 5}]', "x.json"))
    assert list(frame.cells("a")) == [5]
    frame.write_parquet(str(tmp_path / "t.parquet"))
    assert rows(load(spark, str(tmp_path / "t.parquet"))) == [(5,)]
    with pytest.raises(ValueError):
        load(spark, "x.bin")

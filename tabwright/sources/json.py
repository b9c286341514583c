"""JSON files in three orientations: an array of objects, an object of arrays, and columns with data.

A JSON document is one value, so one task parses a document's outermost array;
everything after that is spread over the cluster by rows. A folder or pattern of
files is read as one table of all their rows, in parallel by file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.names import POSITION, named
from tabwright.frame import Frame
from tabwright.operators.position import with_scan_position
from tabwright.sources.files import single_file
from tabwright.sources.inference import Cell, infer
from tabwright.sources.options import JsonOptions, JsonOrientation, LoadOptions

_TOKEN_LIST = T.ArrayType(T.StringType())


class InvalidJson(ValueError):
    """The text is no JSON of an orientation."""


def detect_orientation(text: DataFrame) -> JsonOrientation:
    """From the outermost value: an array holds records; an object with columns and data is split, any other has columns."""
    found = text.select(F.substring(F.ltrim(F.regexp_replace("value", "^[\\s\\ufeff]+", "")), 1, 1).alias("mark"), F.json_object_keys("value").alias("keys")).first()
    if found is None:
        raise InvalidJson("there is no JSON")
    if found["mark"] == "[":
        return JsonOrientation.RECORDS
    if found["mark"] == "{" and found["keys"] is not None:
        return JsonOrientation.SPLIT if {"columns", "data"} <= set(found["keys"]) else JsonOrientation.COLUMNS
    raise InvalidJson("the outermost JSON value is neither an array nor an object")


def _raw(text: Column, as_object: bool) -> Column:
    """Members as variants, which keep their JSON types."""
    kind = T.MapType(T.StringType(), T.VariantType()) if as_object else T.ArrayType(T.VariantType())
    return F.from_json(text, kind)


def _cell(v: Column) -> Cell:
    """A variant as cell: its text, nested values as compact JSON, and number, string or other."""
    kind = F.schema_of_variant(v)
    is_null = v.isNull() | F.is_variant_null(v)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    boolean = F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
    text = F.when(nested, F.to_json(v)).otherwise(F.coalesce(boolean, F.try_variant_get(v, "$", "string")))
    name = F.when(kind == "STRING", F.lit("string")).when(nested | (kind == "BOOLEAN"), F.lit("other")).otherwise(F.lit("number"))
    return Cell(F.when(~is_null, text), F.when(~is_null, name))


def load_json(spark: SparkSession, path: str, options: LoadOptions | None = None) -> Frame:
    """A frame of a JSON file.

    Records: the columns are the first object's keys; other keys are passed over,
    missing ones null, null elements no rows. Columns: arrays of one length. Split:
    short rows end in nulls, long ones are cut. Without any row all columns are text.
    """
    options = JsonOptions.of(options)
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\ufeff", "").alias("value"))
    if text.filter(F.try_parse_json("value").isNotNull()).limit(1).count() == 0:
        raise InvalidJson(f"{path} isn't JSON")
    orientation = options.orientation or detect_orientation(text)
    read = {JsonOrientation.RECORDS: _records, JsonOrientation.COLUMNS: _columns, JsonOrientation.SPLIT: _split}[orientation]
    names, rows = read(text)
    placed = with_scan_position(rows)
    # Cells are told apart once, before the types are tested.
    cells = [_cell(F.col(f"c{i}")) for i in range(len(names))]
    told = placed.select(POSITION, *[c.text.alias(f"t{i}") for i, c in enumerate(cells)], *[c.json_type.alias(f"k{i}") for i, c in enumerate(cells)])
    return infer(told, {n: Cell(F.col(f"t{i}"), F.col(f"k{i}")) for i, n in enumerate(names)}, options.categorical_threshold, empty_is_text=True)


def _unique(names: list[str | None]) -> list[str]:
    """Names as they are, null ones by their place; of names that differ by case alone the first."""
    return list({(n if n is not None else f"Column{i}").lower(): n if n is not None else f"Column{i}" for i, n in reversed(list(enumerate(names)))}.values())[::-1]


def _records(text: DataFrame) -> tuple[list[str], DataFrame]:
    elements = text.select(F.posexplode(F.from_json("value", _TOKEN_LIST)).alias("at", "element")).filter("element IS NOT NULL")
    if elements.filter(F.json_object_keys("element").isNull()).limit(1).count():
        raise InvalidJson("an element of the array is no object")
    first = elements.select(F.json_object_keys("element").alias("keys")).first()
    names = _unique(first["keys"]) if first else []
    parsed = elements.select(_raw(F.col("element"), as_object=True).alias("m"))
    return names, parsed.select(*[F.try_element_at("m", F.lit(n)).alias(f"c{i}") for i, n in enumerate(names)])


def _columns(text: DataFrame) -> tuple[list[str], DataFrame]:
    found = text.select(F.json_object_keys("value").alias("keys"), F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"))
    names = _unique(found.first()["keys"] or [])
    arrays = found.select(*[F.from_json(F.try_element_at("m", F.lit(n)), T.ArrayType(T.VariantType())).alias(f"c{i}") for i, n in enumerate(names)])
    sizes = arrays.select(*[F.size(F.col(f"c{i}")).alias(f"s{i}") for i in range(len(names))]).first()
    starts = found.select(*[F.substring(F.ltrim(F.try_element_at("m", F.lit(n))), 1, 1).alias(f"s{i}") for i, n in enumerate(names)]).first()
    if names and any(s != "[" for s in starts):
        raise InvalidJson("a column is no array")
    if len(set(sizes)) > 1:
        raise InvalidJson("columns differ in length")
    zipped = arrays.select(F.posexplode(F.arrays_zip(*[F.col(f"c{i}") for i in range(len(names))])).alias("at", "row"))
    return names, zipped.select("row.*") if names else zipped


def _split(text: DataFrame) -> tuple[list[str], DataFrame]:
    found = text.select(F.from_json("value", "columns array<string>, data array<array<variant>>").alias("j")).select("j.*")
    head = found.select("columns", F.col("data").isNull().alias("bare")).first()
    if head["columns"] is None or head["bare"]:
        raise InvalidJson("split JSON needs arrays of columns and data")
    names = [n if n is not None else f"Column{i}" for i, n in enumerate(head["columns"])]
    rows = found.select(F.posexplode("data").alias("at", "row"))
    return names, rows.select(*[F.get("row", F.lit(i)).alias(f"c{i}") for i in range(len(names))])


def json_value(c: Column, kind: T.DataType) -> Column:
    """A cell that Spark writes as JSON: NaN and infinities null, times in round-trip form."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'")
    return c


def write_json(frame: Frame, path: str, orientation: JsonOrientation = JsonOrientation.RECORDS, options: JsonOptions | None = None) -> None:
    """Write a frame as one JSON document, in its order.

    One document needs one writer: records go through it as they come, while
    columns and split gather the frame in one row, so they are for small frames.
    """
    orientation, options = JsonOrientation(orientation), options or JsonOptions()
    names = frame.column_names
    ordered = frame.data.orderBy(*frame.order_names()) if frame.order_names() else frame.data
    values = [json_value(named(n), frame.type_of(n)).alias(n) for n in names]
    keep = {"ignoreNullFields": "false"}
    indent, gap = ("  ", "\n") if options.indented else ("", "")
    if orientation is JsonOrientation.RECORDS:
        rows = ordered.select(F.to_json(F.struct(*values), keep).alias("value"))
        spark = rows.sparkSession
        one = rows.coalesce(1).select(F.monotonically_increasing_id().alias("at"), "value")
        lines = one.select(F.concat(F.when(F.col("at") == 0, F.lit(f"[{gap}{indent}")).otherwise(F.lit(f",{gap}{indent}")), "value").alias("value"))
        end = spark.range(1).select(F.lit(f"{gap}]").alias("value"))
        empty = ordered.limit(1).count() == 0
        document = spark.createDataFrame([("[]",)], "value string") if empty else lines.union(end).coalesce(1)
        single_file(document, path, lambda data, where: data.write.mode("overwrite").text(where, lineSep="\n" if options.indented else " "))
        return
    placed = ordered.select(F.monotonically_increasing_id().alias("__at"), F.struct(*values).alias("__row"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__row"))), lambda x: x["__row"])
    whole = placed.agg(gathered.alias("rows"))
    if orientation is JsonOrientation.COLUMNS:
        columns = [F.col("rows").getField(n).alias(n) for n in names]
        text = F.to_json(F.struct(*columns), keep) if names else F.lit("{}")
    else:
        rows = F.transform("rows", lambda r: F.concat(F.lit("["), F.array_join(F.array(*[_bare(r.getField(n)) for n in names]), ","), F.lit("]")))
        text = F.concat(F.lit(f'{{"columns":{json.dumps(names, ensure_ascii=False)},"data":['), F.array_join(rows, f",{gap}{indent}"), F.lit("]}"))
    single_file(whole.select(text.alias("value")), path, lambda data, where: data.write.mode("overwrite").text(where))


def _bare(c: Column) -> Column:
    """A cell's JSON by itself: the inside of an array of it."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)

"""Dictionary-encoded text columns.

A categorical column is a string column whose field metadata says so. Filters keep
it, so categories without rows stay. Categories come in order of first appearance.
Up to MOST_LISTED of them are listed in the metadata, which the driver holds; a
larger dictionary is a table (code, value) in the shared folder, numbered by a
range shuffle, and its codes are joined on without a broadcast hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.frame import CATEGORICAL, Frame, Series
from tabwright.functions.names import PRIVATE, named
from tabwright.storage import global_order, materialize

#: Dictionaries of more values than this are tables.
MOST_LISTED = 65_536
_CODE, _VALUE = f"{PRIVATE}code", f"{PRIVATE}value"


def to_categorical(frame: Frame, name: str) -> Frame:
    """Encode a string column; its categories come in the order of the frame's rows, however many there are."""
    series = frame.string_column(name)
    place = F.struct(*frame.require_order("to_categorical"))
    firsts = frame.data.filter(series.expr.isNotNull()).groupBy(series.expr.alias(_VALUE)).agg(F.min(place).alias("first"))
    found = [r[0] for r in firsts.orderBy("first").limit(MOST_LISTED + 1).select(_VALUE).collect()]
    if len(found) <= MOST_LISTED:
        return with_categories(frame, series.name, found)
    numbered = global_order(firsts, [F.col("first")], "categories", _CODE)
    table = materialize(numbered.select(F.col(_CODE).cast("int").alias(_CODE), _VALUE), "dictionary")
    path = table.inputFiles()[0].rpartition("/")[0]
    return _marked(frame, series.name, {CATEGORICAL: True, "count": table.count(), "table": path})


def with_categories(frame: Frame, name: str, values: list[str]) -> Frame:
    """Mark a string column as categorical with known categories."""
    return _marked(frame, frame.resolve(name), {CATEGORICAL: True, "count": len(values), "categories": values})


def _marked(frame: Frame, own: str, metadata: dict) -> Frame:
    return Frame(frame.data.select(*[named(c).alias(c, metadata=metadata) if c == own else named(c) for c in frame.data.columns]))


def to_string(frame: Frame, name: str) -> Frame:
    """Decode: the same cells without categories."""
    return _marked(frame, _categorical(frame, name), {})


def _categorical(frame: Frame, name: str) -> str:
    own = frame.resolve(name)
    if not frame.is_categorical(own):
        raise TypeError(f"{own} isn't categorical")
    return own


def _about(frame: Frame, name: str) -> dict:
    return frame.data.schema[_categorical(frame, name)].metadata


def categories(frame: Frame, name: str) -> list[str]:
    """The categories, on the driver; a dictionary that is a table is read with ``category_table`` instead."""
    about = _about(frame, name)
    if "table" in about:
        raise ValueError(f"{name} has {about['count']} categories; read them with category_table")
    return list(about["categories"])


def category_count(frame: Frame, name: str) -> int:
    return _about(frame, name)["count"]


def category_table(frame: Frame, name: str) -> DataFrame:
    """(code, value) of the categories."""
    return _domain(frame, name).toDF("code", "value")


def _domain(frame: Frame, name: str) -> DataFrame:
    about, spark = _about(frame, name), frame.data.sparkSession
    schema = T.StructType([T.StructField(_CODE, T.IntegerType()), T.StructField(_VALUE, T.StringType())])
    if "table" in about:
        return spark.read.schema(schema).parquet(about["table"])
    return spark.createDataFrame(list(enumerate(about["categories"])), schema)


def with_codes(frame: Frame, name: str, code: str = "code") -> Frame:
    """Add each cell's code, -1 for null; by a join with the categories."""
    own, domain = _categorical(frame, name), _domain(frame, name)
    if category_count(frame, own) <= MOST_LISTED:
        domain = F.broadcast(domain)
    joined = frame.data.join(domain, named(own) == F.col(_VALUE), "left")
    kept = [named(c) for c in joined.columns if c not in (_CODE, _VALUE) and c.lower() != code.lower()]
    return Frame(joined.select(*kept, F.coalesce(_CODE, F.lit(-1)).alias(code)))


def decode_category(frame: Frame, name: str, code: int) -> str | None:
    """A code's category; -1 is null, other codes must exist."""
    if code == -1:
        return None
    count = category_count(frame, name)
    if not 0 <= code < count:
        raise IndexError(f"code {code} of {count} categories")
    if "table" in _about(frame, name):
        return _domain(frame, name).filter(F.col(_CODE) == code).first()[_VALUE]
    return categories(frame, name)[code]


def try_get_code(frame: Frame, name: str, value: str | None) -> tuple[bool, int]:
    """Whether a value is a category, and its code; null is one, of code -1."""
    if value is None:
        return True, -1
    if "table" in _about(frame, name):
        row = _domain(frame, name).filter(F.col(_VALUE) == value).first()
        return (True, row[_CODE]) if row else (False, -1)
    found = categories(frame, name)
    return (True, found.index(value)) if value in found else (False, -1)


def value_counts(frame: Frame, name: str) -> DataFrame:
    """(value, count) of every category, 0 for those without rows."""
    own = _categorical(frame, name)
    counts = frame.data.filter(named(own).isNotNull()).groupBy(named(own).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    return _domain(frame, own).join(counts, F.col(_VALUE) == F.col("__cell"), "left").select(F.col(_VALUE).alias("value"), F.coalesce("__n", F.lit(0).cast("long")).alias("count"))


def cardinality_ratio(frame: Frame, name: str) -> float:
    """Categories, those without rows too, over all rows; 0 for no rows."""
    rows = frame.row_count()
    return category_count(frame, name) / rows if rows else 0.0


def equals(series: Series, known: list[str], value: str | None):
    """Cells of a category; a value that is none selects nothing without reading a row."""
    from tabwright.functions.masks import Mask

    if value is not None and value not in known:
        return Mask(F.lit(False))
    return series.equals(value)

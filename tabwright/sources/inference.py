"""Types of columns from all their cells.

Cells come as text, with the JSON type where there is one. A column takes the first
type that all its cells allow: int, double, timestamp, else text, which is
categorical if few values repeat. One aggregation over the whole input tests all
types of all columns at once; a second plan casts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.names import POSITION, named
from tabwright.frame import Frame
from tabwright.functions.categorical import to_categorical

INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
SPECIAL = r"^\s*(NaN|[+-]?Infinity)\s*$"
#: Shapes of dates and times, in the invariant month-first order. Fixed values.
TIME_FORMATS = (
    ("yyyy-MM-dd", r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*$"),
    ("yyyy-MM-dd HH:mm", r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}\s*$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\s*$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\s*$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSS][.SSSSSS][.SSS]", r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+\s*$"),
    ("yyyy/MM/dd", r"^\s*[0-9]{4}/[0-9]{2}/[0-9]{2}\s*$"),
    ("M/d/yyyy", r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s*$"),
    ("M/d/yyyy HH:mm:ss", r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}\s*$"),
)


@dataclass(frozen=True)
class Cell:
    """A column's cells as text, and their JSON type (see json reader) where the source has types."""

    text: Column
    json_type: Column | None = None


def _as_int(c: Cell) -> Column:
    plain = F.when(F.regexp_like(c.text, F.lit(INTEGER)), F.trim(c.text).try_cast("int"))
    if c.json_type is None:
        return plain
    # Native numbers count as integers when they are whole.
    number = c.text.try_cast("double")
    whole = F.when(number == F.floor(number), F.when(number.between(-2147483648, 2147483647), number.try_cast("int")))
    return F.when(c.json_type == "number", whole).when(c.json_type == "string", plain)


def _as_double(c: Cell) -> Column:
    text = F.trim(F.regexp_replace(c.text, ",", ""))
    plain = F.when(F.regexp_like(c.text, F.lit(NUMBER)) | F.regexp_like(c.text, F.lit(SPECIAL)), text.try_cast("double"))
    return plain if c.json_type is None else F.when(c.json_type.isin("number", "string"), plain)


def _as_time(c: Cell) -> Column:
    shaped = [F.when(F.regexp_like(c.text, F.lit(shape)), F.try_to_timestamp(F.trim(c.text), F.lit(form))) for form, shape in TIME_FORMATS]
    found = F.coalesce(*shaped).cast("timestamp_ntz")
    return found if c.json_type is None else F.when(c.json_type == "string", found)


#: The types in the order in which they are tried; ``infer`` takes other lists, with further types in front.
INFERRERS = [("int", _as_int), ("double", _as_double), ("timestamp_ntz", _as_time)]


def infer(data: DataFrame, cells: dict[str, Cell], threshold: float, empty_is_text: bool = False, inferrers: list | None = None) -> Frame:
    """Typed columns of cells over data, which has a position.

    A column without any cell that isn't null is int, or text where empty_is_text
    says so and there are no rows. Text becomes categorical when its distinct
    values, which are counted exactly, are less than the threshold's share of all
    rows.
    """
    inferrers = INFERRERS if inferrers is None else inferrers
    tests = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cells.values()):
        for kind, cast in inferrers:
            tests.append(F.coalesce(F.bool_and(c.text.isNull() | cast(c).isNotNull()), F.lit(True)).alias(f"{kind}_{i}"))
    found = data.agg(*tests).first()
    rows, columns, texts = found["rows"], [], []
    for i, (name, c) in enumerate(cells.items()):
        kind = next((k for k, _ in inferrers if found[f"{k}_{i}"]), None)
        if empty_is_text and not rows:
            kind = None
        if kind is None:
            texts.append(name)
        columns.append((dict(inferrers)[kind](c) if kind else c.text).alias(name))
    frame = Frame(data.select(*columns, POSITION))
    if not rows or threshold >= 1.0:
        return frame
    # Distinct values are counted column by column, so that a row isn't expanded for each.
    for name in texts:
        distinct = frame.data.select(named(name).alias("value")).filter("value IS NOT NULL").distinct().count()
        if distinct / rows < threshold:
            frame = to_categorical(frame, name)
    return frame

"""A frame as text: its first and last rows, its shape and its types."""

from __future__ import annotations

import datetime as dt
import math
from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.names import named

if TYPE_CHECKING:
    from tabwright.frame import Frame

#: Names that the display gives types. Fixed values.
TYPE_NAMES = {"double": "float64", "float": "float32", "int": "int32", "bigint": "int64", "boolean": "bool", "timestamp_ntz": "datetime64", "timestamp": "datetime64", "date": "datetime64"}
NULL = "NaN"
DOTS = "..."
NUMBER_WIDTH = 6


def _general(x: float) -> str:
    """Six significant digits, without trailing zeros; two decimals for whole numbers."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == math.floor(x) and abs(x) < 1e15:
        return f"{x:.2f}"
    text = f"{x:.6G}"
    if "E" in text:
        digits, _, power = text.partition("E")
        return f"{digits}E{power[0]}{power[1:].lstrip('0').zfill(2)}"
    return text


def cell(value: Any) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, float):
        return _general(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.strftime("%Y-%m-%d")
    return str(value)


def _cut(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 1] + "…"


def type_name(frame: Frame, name: str) -> str:
    kind = frame.type_of(name)
    if frame.is_categorical(name):
        return "category"
    return TYPE_NAMES.get(kind.simpleString(), "object")


def display_string(frame: Frame, max_rows: int = 10, max_width: int = 12) -> str:
    """Header, rule, rows with their numbers, shape and types.

    Of more than max_rows rows (all for 0 or less) the first half and the last are
    shown, with a line of dots between. Only these rows reach the driver.
    """
    names, count = frame.column_names, frame.row_count()
    if not names or not count:
        return f"Empty DataFrame\nColumns: [{', '.join(names)}]\n[0 rows × {len(names)} columns]"
    top = max_rows // 2
    if max_rows <= 0 or count <= max_rows:
        ordered = frame.data.orderBy(*frame.order_names()) if frame.order_names() else frame.data
        first, last = ordered.select(*[named(n) for n in names]).collect(), []
    else:
        first = frame.head(top).to_spark().collect() if top else []
        last = frame.tail(max_rows - top).to_spark().collect()
    shown = [(str(i), [cell(v) for v in row]) for i, row in [*enumerate(first), *enumerate(last, count - len(last))]]
    widths = [max(len(DOTS), min(max_width, max(len(n), *(len(cells[i]) for _, cells in shown)))) for i, n in enumerate(names)]
    right = [isinstance(frame.type_of(n), T.NumericType) for n in names]

    def line(number: str, cells: list[str]) -> str:
        padded = [_cut(c, w).rjust(w) if r or c == DOTS else _cut(c, w).ljust(w) for c, w, r in zip(cells, widths, right, strict=True)]
        return f"{number.rjust(NUMBER_WIDTH)} {'  '.join(padded)}"

    lines = [line(number, cells) for number, cells in shown]
    if last:
        lines.insert(len(first), line(DOTS, [DOTS] * len(names)))
    head = [line("", names), "─" * (NUMBER_WIDTH + 1 + sum(widths) + 2 * (len(widths) - 1))]
    types = [f"  {n}: {type_name(frame, n)}" for n in names]
    return "\n".join([*head, *lines, "", f"[{count} rows × {len(names)} columns]", "dtypes:", *types, ""])

"""Comparisons of a column with values, as masks.

Null cells are in no comparison, not even in "not equal". NaN is below every
number and equal to itself, unlike in Spark, which puts it above; only columns of
floating point pay for that with a test of NaN.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.masks import Mask


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _is_nan(value: Any) -> bool:
    return isinstance(value, float) and math.isnan(value)


def _nothing(c: Column) -> Mask:
    return Mask(c.isNotNull() & F.lit(False))


def greater_than(c: Column, value: Any, kind: T.DataType) -> Mask:
    if not is_floating(kind):
        return Mask(c > F.lit(value))
    if _is_nan(value):
        return Mask(c.isNotNull() & ~F.isnan(c))
    return Mask(~F.isnan(c) & (c > F.lit(value)))


def greater_than_or_equal(c: Column, value: Any, kind: T.DataType) -> Mask:
    if not is_floating(kind):
        return Mask(c >= F.lit(value))
    if _is_nan(value):
        return Mask(c.isNotNull())
    return Mask(~F.isnan(c) & (c >= F.lit(value)))


def less_than(c: Column, value: Any, kind: T.DataType, nan_free: bool = False) -> Mask:
    """nan_free: the caller knows that the column holds no NaN, so the comparison alone can be pushed to the scan."""
    if not is_floating(kind) or (nan_free and not _is_nan(value)):
        return Mask(c < F.lit(value))
    if _is_nan(value):
        return _nothing(c)
    return Mask(F.isnan(c) | (c < F.lit(value)))


def less_than_or_equal(c: Column, value: Any, kind: T.DataType, nan_free: bool = False) -> Mask:
    if not is_floating(kind) or (nan_free and not _is_nan(value)):
        return Mask(c <= F.lit(value))
    if _is_nan(value):
        return Mask(F.isnan(c))
    return Mask(F.isnan(c) | (c <= F.lit(value)))


def equal_to(c: Column, value: Any, kind: T.DataType) -> Mask:
    if is_floating(kind) and _is_nan(value):
        return Mask(F.isnan(c))
    return Mask(c == F.lit(value))


def not_equal_to(c: Column, value: Any, kind: T.DataType) -> Mask:
    if is_floating(kind) and _is_nan(value):
        return Mask(c.isNotNull() & ~F.isnan(c))
    return Mask(c != F.lit(value))


def between(c: Column, low: Any, high: Any, kind: T.DataType) -> Mask:
    """Both ends included; NaN ends are below all numbers."""
    low_nan, high_nan = _is_nan(low), _is_nan(high)
    if (high_nan and not low_nan) or (not low_nan and not high_nan and low > high):
        raise ValueError(f"between: {low!r} is above {high!r}")
    return Mask(greater_than_or_equal(c, low, kind).bare & less_than_or_equal(c, high, kind, nan_free=not low_nan).bare)


def is_null(c: Column) -> Mask:
    return Mask(c.isNull())


def is_not_null(c: Column) -> Mask:
    return Mask(c.isNotNull())


def equals_text(c: Column, value: str | None) -> Mask:
    """Cells equal to a string, by code points; None selects the null cells."""
    return Mask(c.isNull() if value is None else c == F.lit(value))


def is_in_text(c: Column, values: Iterable[str | None]) -> Mask:
    """Cells among the strings; null cells never are, whatever the list holds."""
    known = [v for v in dict.fromkeys(values) if v is not None]
    return Mask(c.isin(known)) if known else _nothing(c)


def is_in_categories(c: Column, values: Iterable[str | None]) -> Mask:
    """Cells among the strings; a None in the list selects the null cells."""
    given = list(dict.fromkeys(values))
    found = is_in_text(c, given)
    return Mask(found.bare | c.isNull()) if None in given else found

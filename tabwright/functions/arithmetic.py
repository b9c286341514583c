"""Arithmetic between columns of one numeric class, and with scalars.

A null operand gives null. Integers of 32 bits wrap around; division is of doubles
and gives null where the divisor's cell is 0. Integer and floating columns don't
mix; cast with ``as_double`` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide"}


def numeric_class(kind: T.DataType) -> str:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(kind, T.LongType):
        return "long"
    raise TypeError(f"no arithmetic on {kind.simpleString()}")


def _wrap(c: Column) -> Column:
    """A bigint's low 32 bits as a signed int."""
    return ((c.bitwiseAND(0xFFFFFFFF) + 0x80000000).bitwiseAND(0xFFFFFFFF) - 0x80000000).cast("int")


def _apply(symbol: str, a: Column, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[symbol]()


def combine(symbol: str, a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> tuple[Column, T.DataType]:
    """column symbol column, and its type."""
    left, right = numeric_class(a_kind), numeric_class(b_kind)
    if (left == "double") != (right == "double"):
        raise TypeError(f"{symbol} needs columns of one class, not {a_kind.simpleString()} and {b_kind.simpleString()}")
    if symbol == "/":
        return F.try_divide(a.cast("double"), b.cast("double")), T.DoubleType()
    if left == "double":
        return _apply(symbol, a.cast("double"), b.cast("double")), T.DoubleType()
    if "long" in (left, right):
        return _apply(symbol, a.cast("bigint"), b.cast("bigint")), T.LongType()
    return _wrap(_apply(symbol, a.cast("bigint"), b.cast("bigint"))), T.IntegerType()


def combine_scalar(symbol: str, a: Column, kind: T.DataType, value: float | int) -> tuple[Column, T.DataType]:
    """column symbol scalar, and its type; a scalar divisor of 0 is an error."""
    if symbol == "/":
        if value == 0:
            raise ZeroDivisionError("division of a column by the scalar 0")
        numeric_class(kind)
        return a.cast("double") / F.lit(float(value)), T.DoubleType()
    if numeric_class(kind) == "double":
        return _apply(symbol, a.cast("double"), F.lit(float(value))), T.DoubleType()
    if isinstance(value, float):
        raise TypeError(f"{symbol} of an integer column needs an integer, not {value!r}")
    if numeric_class(kind) == "long":
        return _apply(symbol, a, F.lit(value).cast("bigint")), T.LongType()
    return _wrap(_apply(symbol, a.cast("bigint"), F.lit(value).cast("bigint"))), T.IntegerType()

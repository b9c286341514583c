"""The aggregate functions and whole-column reductions."""

from __future__ import annotations

import enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AggFunc(enum.Enum):
    SUM = "sum"
    MEAN = "mean"
    MIN = "min"
    MAX = "max"
    PROD = "prod"
    MEDIAN = "median"
    VAR = "var"
    STD = "std"
    COUNT = "count"
    NUNIQUE = "nunique"
    FIRST = "first"
    LAST = "last"


#: Functions that take numbers only.
NUMERIC = frozenset({AggFunc.SUM, AggFunc.MEAN, AggFunc.MIN, AggFunc.MAX, AggFunc.PROD, AggFunc.MEDIAN, AggFunc.VAR, AggFunc.STD})
#: Functions that need an order of rows.
ORDERED = frozenset({AggFunc.FIRST, AggFunc.LAST})


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def check_type(func: AggFunc, kind: T.DataType, name: str) -> None:
    if func in NUMERIC and not is_number(kind):
        raise TypeError(f"{func.value} needs numbers; {name} is {kind.simpleString()}")


def _order(order: list[Column], present: Column) -> Column:
    place = order[0] if len(order) == 1 else F.struct(*order)
    return F.when(present, place)


def aggregate(func: AggFunc, c: Column, kind: T.DataType, order: list[Column] | None = None) -> Column:
    """The aggregation of a column. Nulls are passed over; all null gives null, and 0 for count and nunique.

    Min and max pass over NaN too. First and last take the least or greatest cell
    that isn't null by the order's columns, which must not tie.
    """
    number = c.cast("double") if is_number(kind) else c
    not_nan = F.when(~F.isnan(number), number) if isinstance(kind, (T.DoubleType, T.FloatType)) else number
    match func:
        case AggFunc.SUM:
            return F.sum(number)
        case AggFunc.MEAN:
            return F.avg(number)
        case AggFunc.MIN:
            return F.min(not_nan)
        case AggFunc.MAX:
            return F.max(not_nan)
        case AggFunc.PROD:
            return F.product(number)
        case AggFunc.MEDIAN:
            return F.median(number)
        case AggFunc.VAR:
            return F.var_samp(number)
        case AggFunc.STD:
            return F.stddev_samp(number)
        case AggFunc.COUNT:
            return F.count(c)
        case AggFunc.NUNIQUE:
            return F.countDistinct(c)
    if not order:
        raise ValueError(f"{func.value} needs an order of rows; give the frame one with order_by")
    pick = F.min_by if func is AggFunc.FIRST else F.max_by
    return pick(c, _order(order, c.isNotNull()))


#: Whole-column reductions; without any value they give NaN, count 0.
REDUCTIONS = ("sum", "mean", "min", "max", "std", "count")


def reduction(name: str, c: Column) -> Column:
    """A whole double column as one number."""
    nan = F.lit(float("nan"))
    number = F.when(~F.isnan(c), c)
    if name == "count":
        return F.count(c)
    return F.coalesce({"sum": F.sum(c), "mean": F.avg(c), "min": F.min(number), "max": F.max(number), "std": F.stddev_samp(c)}[name], nan)

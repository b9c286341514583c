"""Two-valued row selectors.

A null never makes a mask unknown: it makes it false. A mask keeps its predicate
in two forms. ``bare`` may still be null, which a filter drops like false, so it
is what reaches the scan as a pushed filter. ``total`` is never null and is used
where null and false differ: under a negation, in an exclusive or, and as a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Mask:
    """A selector of rows; build it with the predicates of a column."""

    __slots__ = ("bare",)

    def __init__(self, bare: Column):
        self.bare = bare

    @property
    def total(self) -> Column:
        return F.coalesce(self.bare, F.lit(False))

    def __and__(self, other: Mask) -> Mask:
        return and_(self, other)

    def __or__(self, other: Mask) -> Mask:
        return or_(self, other)

    def __invert__(self) -> Mask:
        return not_(self)

    def __xor__(self, other: Mask) -> Mask:
        return xor(self, other)

    def __bool__(self) -> bool:
        raise TypeError("a mask has no truth value; combine masks with &, |, ~ and ^")


def and_(a: Mask, b: Mask) -> Mask:
    return Mask(a.bare & b.bare)


def or_(a: Mask, b: Mask) -> Mask:
    return Mask(a.bare | b.bare)


def not_(a: Mask) -> Mask:
    """Rows that a doesn't select; rows whose predicate met a null are among them."""
    return Mask(~a.total)


def xor(a: Mask, b: Mask) -> Mask:
    return Mask(a.total != b.total)


def all_(*masks: Mask) -> Mask:
    """Rows that every mask selects."""
    if not masks:
        raise ValueError("all_ needs a mask")
    return reduce(and_, masks)


def any_(*masks: Mask) -> Mask:
    """Rows that some mask selects."""
    if not masks:
        raise ValueError("any_ needs a mask")
    return reduce(or_, masks)


def count_true(data: DataFrame, mask: Mask) -> int:
    """How many rows a mask selects."""
    return data.agg(F.count_if(mask.total)).first()[0]

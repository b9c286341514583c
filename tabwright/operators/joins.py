"""Equi-joins with explicit rules for keys and names."""

from __future__ import annotations

import enum
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.names import ORDER, named

if TYPE_CHECKING:
    from tabwright.frame import Frame


class JoinType(enum.Enum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    OUTER = "outer"


_SPARK = {JoinType.INNER: "inner", JoinType.LEFT: "left", JoinType.RIGHT: "right", JoinType.OUTER: "full"}


def key_class(kind: T.DataType) -> str:
    """Types that can be joined with each other have one class."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    return kind.simpleString()


def _keys(frame: Frame, names: Sequence[str], side: str) -> list[str]:
    if not names:
        raise ValueError(f"merge needs a key on the {side}")
    for name in names:
        if not name or not name.strip():
            raise ValueError(f"merge has a blank key on the {side}")
        if not frame.contains_column(name):
            raise ValueError(f"merge key {name!r} isn't a column of the {side} frame")
    return [frame.resolve(n) for n in names]


def merge(left: Frame, right: Frame, left_on: Sequence[str], right_on: Sequence[str], how: JoinType | str = JoinType.INNER, ordered: bool = False) -> Frame:
    """Join two frames on equal keys.

    A null in any part of a key matches nothing; rows that share keys are paired
    in all ways. The result has the keys once, under the left names and with the
    right value where the left row is missing; then the other columns of the left
    and of the right. Names on both sides get ``_x`` and ``_y``. Keys must be of
    one class of types, and a name that would come twice is an error. Spark picks
    the join: a side is broadcast only where its size is known to be small.

    ordered: the result has an order, which both frames must have: that of the left
    rows, for each of them that of its right rows, and last the right rows without a
    partner in their own. It costs carrying both orders through the join; nothing is
    sorted before head, tail or a writer asks for it.
    """
    how = JoinType(how)
    if len(left_on) != len(right_on):
        raise ValueError(f"merge has {len(left_on)} left keys and {len(right_on)} right keys")
    lk, rk = _keys(left, left_on, "left"), _keys(right, right_on, "right")
    for a, b in zip(lk, rk, strict=True):
        if key_class(left.type_of(a)) != key_class(right.type_of(b)):
            raise TypeError(f"merge can't match {a} ({left.type_of(a).simpleString()}) with {b} ({right.type_of(b).simpleString()})")
    l_rest, r_rest = [c for c in left.column_names if c not in lk], [c for c in right.column_names if c not in rk]
    lows, rows = {c.lower() for c in l_rest}, {c.lower() for c in r_rest}
    l_new = [f"{c}_x" if c.lower() in rows else c for c in l_rest]
    r_new = [f"{c}_y" if c.lower() in lows else c for c in r_rest]
    names = [*lk, *l_new, *r_new]
    twice = [n for n in names if sum(n.lower() == m.lower() for m in names) > 1]
    if twice:
        raise ValueError(f"merge would give {', '.join(dict.fromkeys(twice))} more than once; rename columns first")
    a = left.data.select(*[named(c).alias(f"l{i}") for i, c in enumerate([*lk, *l_rest])])
    b = right.data.select(*[named(c).alias(f"r{i}") for i, c in enumerate([*rk, *r_rest])])
    if ordered:
        a = left.data.select(*[named(c).alias(f"l{i}") for i, c in enumerate([*lk, *l_rest])], F.struct(*left.require_order("an ordered merge")).alias("lo"))
        b = right.data.select(*[named(c).alias(f"r{i}") for i, c in enumerate([*rk, *r_rest])], F.struct(*right.require_order("an ordered merge")).alias("ro"))
    joined = a.join(b, [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(lk))], _SPARK[how])
    # Only right and outer joins can lack the left key.
    keys = [(F.coalesce(F.col(f"l{i}"), F.col(f"r{i}")) if how in (JoinType.RIGHT, JoinType.OUTER) else F.col(f"l{i}")).alias(k) for i, k in enumerate(lk)]
    rest = [F.col(f"l{i + len(lk)}").alias(n) for i, n in enumerate(l_new)] + [F.col(f"r{i + len(rk)}").alias(n) for i, n in enumerate(r_new)]
    if ordered:
        order = [F.col("lo").isNull().alias(f"{ORDER}0"), F.col("lo").alias(f"{ORDER}1"), F.col("ro").alias(f"{ORDER}2")]
        return left.of(joined.select(*keys, *rest, *order), ordered=True)
    return left.of(joined.select(*keys, *rest))

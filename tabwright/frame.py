"""The data frame: named, typed columns over a lazy Spark plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.names import ORDER, POSITION, PRIVATE, is_private, named
from tabwright.functions import arithmetic, predicates
from tabwright.functions.aggregates import REDUCTIONS, AggFunc, reduction
from tabwright.functions.masks import Mask, count_true
from tabwright.operators import joins
from tabwright.operators.grouping import GroupByOptions, Grouping
from tabwright.operators.position import with_contiguous_position, with_scan_position

CATEGORICAL = "categorical"


class Series:
    """A column of a frame: a name, a type and an expression over the frame's rows."""

    __slots__ = ("expr", "kind", "name")

    def __init__(self, name: str, kind: T.DataType, expr: Column):
        if not name or not name.strip():
            raise ValueError("a column needs a name")
        self.name, self.kind, self.expr = name, kind, expr

    def renamed(self, name: str) -> Series:
        return Series(name, self.kind, self.expr)

    # -- predicates -------------------------------------------------------------

    def greater_than(self, value: Any) -> Mask:
        return predicates.greater_than(self.expr, value, self.kind)

    def greater_than_or_equal(self, value: Any) -> Mask:
        return predicates.greater_than_or_equal(self.expr, value, self.kind)

    def less_than(self, value: Any, nan_free: bool = False) -> Mask:
        return predicates.less_than(self.expr, value, self.kind, nan_free)

    def less_than_or_equal(self, value: Any, nan_free: bool = False) -> Mask:
        return predicates.less_than_or_equal(self.expr, value, self.kind, nan_free)

    def equal_to(self, value: Any) -> Mask:
        return predicates.equal_to(self.expr, value, self.kind)

    def not_equal_to(self, value: Any) -> Mask:
        return predicates.not_equal_to(self.expr, value, self.kind)

    def between(self, low: Any, high: Any) -> Mask:
        return predicates.between(self.expr, low, high, self.kind)

    def is_null(self) -> Mask:
        return predicates.is_null(self.expr)

    def is_not_null(self) -> Mask:
        return predicates.is_not_null(self.expr)

    def equals(self, value: str | None) -> Mask:
        return predicates.equals_text(self.expr, value)

    def is_in(self, *values: str | None) -> Mask:
        return predicates.is_in_text(self.expr, values)

    def is_in_categories(self, *values: str | None) -> Mask:
        return predicates.is_in_categories(self.expr, values)

    # -- arithmetic ---------------------------------------------------------------

    def _combine(self, symbol: str, other: Series | float | int) -> Series:
        if other is None:
            raise ValueError(f"{symbol} needs an operand")
        if isinstance(other, Series):
            expr, kind = arithmetic.combine(symbol, self.expr, self.kind, other.expr, other.kind)
            return Series(f"{self.name}{symbol}{other.name}", kind, expr)
        expr, kind = arithmetic.combine_scalar(symbol, self.expr, self.kind, other)
        return Series(self.name, kind, expr)

    def add(self, other: Series | float | int) -> Series:
        return self._combine("+", other)

    def subtract(self, other: Series | float | int) -> Series:
        return self._combine("-", other)

    def multiply(self, other: Series | float | int) -> Series:
        return self._combine("*", other)

    def divide(self, other: Series | float | int) -> Series:
        return self._combine("/", other)

    __add__, __sub__, __mul__, __truediv__ = add, subtract, multiply, divide

    def as_double(self) -> Series:
        arithmetic.numeric_class(self.kind)
        return Series(self.name, T.DoubleType(), self.expr.cast("double"))


class Frame:
    """Columns of one length over a Spark plan.

    Names are matched without regard to case and aren't blank. Nothing runs until
    a result is asked for. What depends on an order of rows (head, tail, first,
    last, positions, categories, display) uses the columns given as ``order_by``,
    which should name a row each; a file read by this package has the order in
    which its rows are read. The order's columns stay available when the frame is
    narrowed; Catalyst drops them from plans that don't use them. Names may hold any
    characters, dots too; those that begin with ``__tabwright_`` are refused.
    """

    def __init__(self, data: DataFrame, order_by: Sequence[str] = ()):
        names = [c for c in data.columns if not is_private(c)]
        for name in names:
            if not name.strip():
                raise ValueError("a column needs a name")
        if len({n.lower() for n in names}) < len(names):
            raise ValueError("column names must differ by more than case")
        for i, column in enumerate(order_by):
            data = data.withColumn(f"{ORDER}{i}", named(column))
        self.data = data

    # -- construction -------------------------------------------------------------

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str, order_by: Sequence[str] = ()) -> Frame:
        return cls.over(spark.read.parquet(path), order_by)

    @classmethod
    def over(cls, data: DataFrame, order_by: Sequence[str] = ()) -> Frame:
        """A frame over a plan from elsewhere, all of whose columns are the user's own."""
        taken = [c for c in data.columns if is_private(c)]
        if taken:
            raise ValueError(f"{', '.join(taken)}: names that begin with {PRIVATE} are kept for frames")
        return cls(data, order_by)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> Frame:
        """A frame of rows in memory, in their order."""
        data = cls.over(spark.createDataFrame(list(rows), schema)).data
        return cls(with_scan_position(data.coalesce(1)))

    @classmethod
    def from_columns(cls, spark: SparkSession, columns: Sequence[tuple[str, T.DataType | str, Sequence]]) -> Frame:
        """A frame of (name, type, cells) in memory; a name that comes again replaces the cells in the first one's place."""
        kept: dict[str, tuple] = {}
        for name, kind, cells in columns:
            if cells is None:
                raise ValueError(f"column {name!r} has no cells")
            key = name.lower()
            kept[key] = (kept[key][0] if key in kept else name, kind, list(cells))
        if len({len(c) for _, _, c in kept.values()}) > 1:
            raise ValueError("columns differ in length")
        fields = [T.StructField(n, k if isinstance(k, T.DataType) else T.DataType.fromDDL(k)) for n, k, _ in kept.values()]
        return cls.from_rows(spark, zip(*[c for _, _, c in kept.values()], strict=True), T.StructType(fields))

    def of(self, data: DataFrame, ordered: bool = False) -> Frame:
        """A frame over another plan; without an order unless the plan still has this one's."""
        if not ordered:
            data = data.drop(*[c for c in data.columns if c.startswith(ORDER) or c == POSITION])
        return Frame(data)

    # -- names and types -----------------------------------------------------------

    @property
    def column_names(self) -> list[str]:
        return [c for c in self.data.columns if not is_private(c)]

    @property
    def column_count(self) -> int:
        return len(self.column_names)

    def row_count(self) -> int:
        return self.data.count()

    def contains_column(self, name: str) -> bool:
        return any(c.lower() == (name or "").lower() for c in self.column_names)

    def resolve(self, name: str) -> str:
        """The column's own spelling of a name."""
        for c in self.column_names:
            if c.lower() == (name or "").lower():
                return c
        raise KeyError(f"no column {name!r}; there are {', '.join(self.column_names)}")

    def type_of(self, name: str) -> T.DataType:
        return self.data.schema[self.resolve(name)].dataType

    def visible_schema(self) -> T.StructType:
        return T.StructType([f for f in self.data.schema.fields if not is_private(f.name)])

    def is_categorical(self, name: str) -> bool:
        return bool(self.data.schema[self.resolve(name)].metadata.get(CATEGORICAL))

    def to_spark(self) -> DataFrame:
        """The frame's columns as a Spark data frame."""
        return self.data.select(*[named(c) for c in self.column_names])

    # -- order -----------------------------------------------------------------------

    def order_names(self) -> list[str]:
        given = [c for c in self.data.columns if c.startswith(ORDER)]
        return given or [c for c in self.data.columns if c == POSITION]

    def order_columns(self) -> list[Column]:
        return [F.col(c) for c in self.order_names()]

    def require_order(self, what: str) -> list[str]:
        if not self.order_names():
            raise ValueError(f"{what} needs an order of rows; give the frame one with order_by")
        return self.order_names()

    def ordered_by(self, *columns: str) -> Frame:
        """The same rows in the order of some columns."""
        return Frame(self.to_spark(), [self.resolve(c) for c in columns])

    # -- columns ---------------------------------------------------------------------

    def _hidden(self) -> list[Column]:
        return [F.col(c) for c in self.data.columns if is_private(c)]

    def __getitem__(self, key: str | int) -> Series:
        if isinstance(key, int):
            if not 0 <= key < self.column_count:
                raise IndexError(f"column {key} of {self.column_count}")
            key = self.column_names[key]
        name = self.resolve(key)
        return Series(name, self.type_of(name), named(name))

    def column(self, name: str, kind: T.DataType) -> Series:
        """A column that must be of exactly this type and not categorical."""
        found = self[name]
        if found.kind != kind or self.is_categorical(name):
            raise TypeError(f"{found.name} is {CATEGORICAL if self.is_categorical(name) else found.kind.simpleString()}, not {kind.simpleString()}")
        return found

    def string_column(self, name: str) -> Series:
        return self.column(name, T.StringType())

    def select(self, *names: str) -> Frame:
        """Columns in the order asked for; a name that comes again is passed over."""
        if not names:
            raise ValueError("select needs a column")
        wanted = dict.fromkeys(self.resolve(n) for n in names)
        return Frame(self.data.select(*[named(n) for n in wanted], *self._hidden()))

    def add_column(self, series: Series) -> Frame:
        """The frame with a column at its end, or in the place and under the spelling of one of that name."""
        if self.contains_column(series.name):
            name = self.resolve(series.name)
            columns = [series.expr.alias(c) if c == name else named(c) for c in self.column_names]
            return Frame(self.data.select(*columns, *self._hidden()))
        return Frame(self.data.select(*[named(c) for c in self.column_names], series.expr.alias(series.name), *self._hidden()))

    def try_remove_column(self, name: str) -> tuple[Frame, bool]:
        """The frame without a column, and whether it had it."""
        if not self.contains_column(name):
            return self, False
        own = self.resolve(name)
        return Frame(self.data.select(*[named(c) for c in self.column_names if c != own], *self._hidden())), True

    # -- rows ------------------------------------------------------------------------

    def where(self, mask: Mask) -> Frame:
        return Frame(self.data.filter(mask.bare))

    def head(self, n: int = 5) -> Frame:
        """The first n rows in the frame's order."""
        if n <= 0:
            raise ValueError("head needs a positive number of rows")
        return Frame(self.data.orderBy(*self.require_order("head")).limit(n))

    def tail(self, n: int = 5) -> Frame:
        """The last n rows in the frame's order."""
        if n <= 0:
            raise ValueError("tail needs a positive number of rows")
        order = self.require_order("tail")
        return Frame(self.data.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order))

    def with_position(self, name: str = "position") -> Frame:
        """The frame with each row's number from 0 in its order."""
        numbered = with_contiguous_position(self.data, self.require_order("with_position"), f"{PRIVATE}number")
        return Frame(numbered.select(*[named(c) for c in self.column_names], F.col(f"{PRIVATE}number").alias(name), *self._hidden()))

    def true_positions(self, mask: Mask) -> DataFrame:
        """(position) of the rows that a mask selects, in order."""
        masked = Frame(self.data.select(mask.total.alias("hit"), *self._hidden())).with_position()
        return masked.data.filter("hit").select("position").orderBy("position")

    def count_true(self, mask: Mask) -> int:
        return count_true(self.data, mask)

    def row_at(self, position: int) -> tuple | None:
        """The cells of one row; for looking, not for loops."""
        found = self.with_position(f"{PRIVATE}at").data.filter(F.col(f"{PRIVATE}at") == position).select(*[named(c) for c in self.column_names]).first()
        return None if found is None else tuple(found)

    def cells(self, name: str) -> Iterator[Any]:
        """A column's cells in the frame's order, a partition at a time; for looking, not for loops."""
        ordered = self.data.orderBy(*self.order_names()) if self.order_names() else self.data
        return (row[0] for row in ordered.select(self[name].expr).toLocalIterator())

    def write_parquet(self, path: str) -> None:
        """An extension: the frame's columns as a table of Parquet files, written by all tasks."""
        self.to_spark().write.mode("overwrite").parquet(path)

    # -- results ---------------------------------------------------------------------

    def reduce(self, spec: dict[str, Sequence[str]]) -> DataFrame:
        """One row of ``{column}_{reduction}`` for whole double columns, in one pass."""
        found = []
        for name, wanted in spec.items():
            series = self[name]
            if not predicates.is_floating(series.kind):
                raise TypeError(f"{series.name} is {series.kind.simpleString()}; reductions are of doubles")
            for what in wanted:
                if what not in REDUCTIONS:
                    raise ValueError(f"no reduction {what!r}")
                found.append(reduction(what, series.expr).alias(f"{series.name}_{what}"))
        return self.data.agg(*found)

    def reduction(self, name: str, what: str) -> float | int:
        return self.reduce({name: [what]}).first()[0]

    def group_by(self, *keys: str, options: GroupByOptions | None = None) -> Grouping:
        return Grouping(self, keys, options)

    def merge(
        self, right: Frame, on: str | Sequence[str] | None = None, how: joins.JoinType | str = joins.JoinType.INNER, left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None, ordered: bool = False
    ) -> Frame:
        """Join on columns of one name (on) or of two (left_on, right_on); see ``joins.merge`` for ordered."""
        if on is not None:
            keys = [on] if isinstance(on, str) else list(on)
            return joins.merge(self, right, keys, keys, how, ordered)
        return joins.merge(self, right, list(left_on or ()), list(right_on or ()), how, ordered)

    def display_string(self, max_rows: int = 10, max_width: int = 12) -> str:
        from tabwright.functions.display import display_string

        return display_string(self, max_rows, max_width)

    def print(self, write: Callable[[str], Any] = print, max_rows: int = 10, max_width: int = 12) -> None:
        write(self.display_string(max_rows, max_width))


__all__ = ["AggFunc", "Frame", "Series"]

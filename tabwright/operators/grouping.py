"""Grouping: aggregation, group filters, transforms and per-group functions.

Groups are of native keys, and null is a key like any other. Aggregations are
Spark's partial and final hash aggregations; nothing gathers a group in one task
but the opaque Python functions that ask for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.names import ORDER, PRIVATE, is_private, named
from tabwright.functions.aggregates import ORDERED, AggFunc, aggregate, check_type, is_number
from tabwright.functions.masks import Mask

if TYPE_CHECKING:
    import pandas as pd

    from tabwright.frame import Frame


@dataclass(frozen=True)
class GroupByOptions:
    """key_separator joins the parts of a group's label, in ``group_sizes`` alone; keys_as_string gives keys as text in results."""

    key_separator: str = "|"
    keys_as_string: bool = False

    def __post_init__(self):
        if not self.key_separator:
            raise ValueError("key_separator must not be empty")


class Grouping:
    """A frame and its keys; made by ``Frame.group_by``."""

    def __init__(self, frame: Frame, keys: tuple[str, ...], options: GroupByOptions | None = None):
        if not keys:
            raise ValueError("group_by needs a key")
        self.frame = frame
        self.options = options or GroupByOptions()
        self.keys = list(dict.fromkeys(frame.resolve(k) for k in keys))

    # -- results a row a group ------------------------------------------------

    def _key_columns(self) -> list[Column]:
        return [named(k).cast("string").alias(k) if self.options.keys_as_string else named(k) for k in self.keys]

    def _value(self, name: str, func: AggFunc, window: WindowSpec | None = None) -> Column:
        kind = self.frame.type_of(name)
        check_type(func, kind, name)
        if func in ORDERED:
            self.frame.require_order(func.value)
        found = aggregate(func, named(name), kind, self.frame.order_columns())
        if window is not None:
            found = found.over(window)
        if func is AggFunc.COUNT:
            return found
        return found.cast("double") if func is AggFunc.NUNIQUE or is_number(kind) else found

    def _first(self) -> list[Column]:
        """Where a group first appears, as the order of a result of groups."""
        return [F.min(F.struct(*self.frame.require_order("the order of groups"))).alias(f"{ORDER}0")]

    def agg(self, spec: Mapping[str, AggFunc], ordered: bool = False) -> Frame:
        """One function for each column; results keep the columns' names.

        A result of a key column's own name takes the key's place. Counts are
        bigint, everything else is double, but first and last of columns that
        aren't numbers keep their type. ordered: the groups have the order in which
        they first appear in the frame's, for one more aggregate.
        """
        if not spec:
            raise ValueError("agg needs a column")
        found = {self.frame.resolve(name): AggFunc(func) for name, func in spec.items()}
        values = [self._value(name, func).alias(f"{PRIVATE}{i}") for i, (name, func) in enumerate(found.items())]
        order = self._first() if ordered else []
        grouped = self.frame.data.groupBy(*map(named, self.keys)).agg(*values, *order)
        new = {name: f"{PRIVATE}{i}" for i, name in enumerate(found)}
        keys = [F.col(new[k]).alias(k) if k in new else column for k, column in zip(self.keys, self._key_columns(), strict=True)]
        rest = [F.col(c).alias(name) for name, c in new.items() if name not in self.keys]
        return self.frame.of(grouped.select(*keys, *rest, *[F.col(f"{ORDER}0")] * ordered), ordered)

    def count(self, ordered: bool = False) -> Frame:
        """Rows of each group, as the double column ``count``; ordered as in ``agg``."""
        order = self._first() if ordered else []
        grouped = self.frame.data.groupBy(*map(named, self.keys)).agg(F.count(F.lit(1)).cast("double").alias(f"{PRIVATE}count"), *order)
        keys = [c for k, c in zip(self.keys, self._key_columns(), strict=True) if k.lower() != "count"]
        return self.frame.of(grouped.select(*keys, F.col(f"{PRIVATE}count").alias("count"), *[F.col(f"{ORDER}0")] * ordered), ordered)

    def group_count(self) -> int:
        """How many groups there are, null groups included."""
        return self.frame.data.select(*map(named, self.keys)).distinct().count()

    def group_sizes(self) -> Frame:
        """(group, size): each group's label, its keys joined by the separator with null as ``\\0null``, and its rows."""
        parts = [F.coalesce(named(k).cast("string"), F.lit("\0null")) for k in self.keys]
        grouped = self.frame.data.groupBy(*map(named, self.keys)).agg(F.count(F.lit(1)).alias("size"))
        return self.frame.of(grouped.select(F.concat_ws(self.options.key_separator, *parts).alias("group"), "size"))

    # -- results a row a row --------------------------------------------------

    def _joined_back(self, values: DataFrame, names: list[str]) -> DataFrame:
        """The frame's rows with their group's values; equal keys join, null with null."""
        right = values.select(*[named(k).alias(f"{PRIVATE}key_{i}") for i, k in enumerate(self.keys)], *names)
        match = [F.equal_null(named(k), F.col(f"{PRIVATE}key_{i}")) for i, k in enumerate(self.keys)]
        return self.frame.data.join(right, match).select(*map(named, self.frame.data.columns), *names)

    def _with_values(self, columns: dict[str, Column]) -> DataFrame:
        """Each row with its group's aggregates.

        The aggregates are joined back instead of taken over a window: a window
        would sort all rows by key and hold a group in one task, while the
        aggregation combines before it shuffles, and the join is broadcast or
        split where a key is hot.
        """
        grouped = self.frame.data.groupBy(*map(named, self.keys)).agg(*[c.alias(n) for n, c in columns.items()])
        return self._joined_back(grouped, list(columns))

    def filter(self, having: Mapping[str, tuple[AggFunc, Callable[[Column], Column]]] | Callable[[pd.DataFrame], bool], regrouped: bool = False) -> Frame:
        """All rows of the groups that pass.

        having: for each column a function and a test of its result, all of which
        must hold (null fails); or a Python function of a group's rows, for which
        each group is gathered in one task. The schema stays, also without rows.
        regrouped: the result's order is that of the groups' first rows, and within a
        group the frame's; without it, it is the frame's.
        """
        if callable(having):
            if regrouped:
                raise ValueError("rows are regrouped for tests of columns only")
            return self._python(lambda rows: rows if having(rows) else rows.iloc[:0], self.frame.data.schema)
        columns, tests = {}, []
        for i, (name, (func, test)) in enumerate(having.items()):
            columns[f"{PRIVATE}v{i}"] = self._value(self.frame.resolve(name), AggFunc(func))
            tests.append(Mask(test(F.col(f"{PRIVATE}v{i}"))).bare)
        if regrouped:
            columns[f"{PRIVATE}first"] = self._first()[0]
        rows = self._with_values(columns)
        for test in tests:
            rows = rows.filter(test)
        if regrouped:
            own = self.frame.order_names()
            visible = [named(c) for c in self.frame.column_names]
            rows = rows.select(*visible, F.col(f"{PRIVATE}first").alias(f"{ORDER}0"), *[F.col(c).alias(f"{ORDER}{i}") for i, c in enumerate(own, 1)])
            return self.frame.of(rows, ordered=True)
        return self.frame.of(rows.drop(*columns), ordered=True)

    def filter_size(self, test: Callable[[Column], Column]) -> Frame:
        """All rows of the groups whose number of rows passes."""
        rows = self._with_values({f"{PRIVATE}size": F.count(F.lit(1))})
        return self.frame.of(rows.filter(test(F.col(f"{PRIVATE}size"))).drop(f"{PRIVATE}size"), ordered=True)

    def transform(self, name: str, func: AggFunc, window: bool = False) -> Frame:
        """The frame with a column ``{name}_{func}``: each row's group's result.

        window: take it over a window, which spares the join where groups are
        known to be small; nunique always joins.
        """
        name, func = self.frame.resolve(name), AggFunc(func)
        new = f"{name}_{func.value}"
        if window and func is not AggFunc.NUNIQUE:
            rows = self.frame.data.withColumn(f"{PRIVATE}value", self._value(name, func, Window.partitionBy(*map(named, self.keys))))
        else:
            value = self._value(name, func)
            rows = self._with_values({f"{PRIVATE}value": value.cast("bigint") if func is AggFunc.NUNIQUE else value})
        return self.frame.of(rows.drop(new).withColumnRenamed(f"{PRIVATE}value", new), ordered=True)

    def apply(self, function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: T.StructType | str | None = None) -> Frame:
        """A Python function of each group's rows; None gives no rows.

        The function sees the frame's columns; schema is of its result, by default
        the frame's own. Each group is gathered in one task, so a group must fit
        in a worker's memory.
        """
        given = self.frame.visible_schema() if schema is None else schema
        return self._python(function, given)

    def _python(self, function: Callable, schema: T.StructType | str) -> Frame:
        import pandas as pd

        visible = schema if isinstance(schema, str) else T.StructType(list(schema.fields))
        spark = self.frame.data.sparkSession
        names = spark.createDataFrame([], visible).columns if isinstance(visible, str) else visible.names
        order = [c for c in self.frame.data.columns if is_private(c)]

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            if order:
                rows = rows.sort_values(order, ignore_index=True)
            found = function(rows if any(n in order for n in names) else rows.drop(columns=order))
            if found is None:
                return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
            return found[names]

        keep_order = all(o in names for o in order) and bool(order)
        return self.frame.of(self.frame.data.groupBy(*map(named, self.keys)).applyInPandas(run, visible), ordered=keep_order)

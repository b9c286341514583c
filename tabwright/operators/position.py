"""Row positions, for what depends on an order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.names import POSITION, named
from tabwright.storage import global_order


def with_scan_position(data: DataFrame) -> DataFrame:
    """Add the position: increasing in the order in which a source reads its rows, not contiguous."""
    return data.withColumn(POSITION, F.monotonically_increasing_id())


def with_contiguous_position(data: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number the rows 0, 1, ... by the order's columns; no task sees more than a range of them."""
    return global_order(data, [named(c) for c in order], "position", name)

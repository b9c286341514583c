"""Names of columns: quoting, and the prefix of the columns that frames keep for themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of these names hold a frame's order and values on their way; no column of a user's may.
PRIVATE = "__tabwright_"
POSITION = f"{PRIVATE}pos"
ORDER = f"{PRIVATE}ord"


def named(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_private(name: str) -> bool:
    return name.startswith(PRIVATE)

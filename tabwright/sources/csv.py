"""CSV files: reading with types from all cells, and writing.

Any path that Spark reads will do: a file, a folder or a pattern. Tasks read
splits of files; the driver sees the header line alone.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.names import named
from tabwright.frame import Frame
from tabwright.operators.position import with_scan_position
from tabwright.sources.files import single_file
from tabwright.sources.inference import Cell, infer
from tabwright.sources.options import CsvOptions, LoadOptions


#: Holds a row's text where it has another number of fields than the header.
_BROKEN = "__broken"


def normalize_headers(raw: list[str | None]) -> list[str]:
    """Trimmed names; blank ones by their place, ones that come again numbered."""
    times: dict[str, int] = {}
    names = []
    for i, cell in enumerate(raw):
        name = (cell or "").strip() or f"Column{i}"
        seen = times.get(name.lower(), 0)
        times[name.lower()] = seen + 1
        names.append(f"{name}_{seen}" if seen else name)
    return names


def _reader(spark: SparkSession, options: CsvOptions):
    return (
        spark.read.option("sep", options.delimiter)
        .option("quote", options.quote)
        .option("escape", options.quote)
        .option("encoding", options.encoding)
        .option("multiLine", options.multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .option("emptyValue", "")
        .option("nullValue", "\0")
    )


def load_csv(spark: SparkSession, path: str, options: LoadOptions | None = None) -> Frame:
    """A frame of a CSV file.

    Lines of white space are passed over, short rows end in nulls, long ones are
    cut to the header, and an empty file is an error.
    """
    if not path or not path.strip():
        raise ValueError("load_csv needs a path")
    options = CsvOptions.of(options)
    lines = spark.read.option("encoding", options.encoding).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    first = lines.filter(F.trim(F.regexp_replace("value", "\\s+", " ")) != "").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    head = next(csv.reader([first["value"]], delimiter=options.delimiter, quotechar=options.quote))
    width = len(head)
    names = normalize_headers(head) if options.has_header else [f"Column{i}" for i in range(width)]
    schema = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(width)), T.StructField(_BROKEN, T.StringType())])
    # With a schema of its own, Spark leaves out each file's header without looking at it.
    raw = with_scan_position(_reader(spark, options).option("header", options.has_header).schema(schema).csv(path))
    # A line of white space is a single field, so among several columns it is a broken row.
    blank = F.coalesce(F.regexp_like(F.col(_BROKEN if width > 1 else "c0"), F.lit(r"^\s+$")), F.lit(False))
    rows = raw.filter(~blank)
    cells = {n: Cell(_cell(i, width, options)) for i, n in enumerate(names)}
    return infer(rows, cells, options.categorical_threshold)


def _cell(i: int, width: int, options: CsvOptions) -> Column:
    """A field's text. Spark reads an empty field as null, and so the end of a short row.

    Where empty fields are to stay text, nulls become empty again, but for those at
    the end of a row of another length than the header's.
    """
    c = F.col(f"c{i}")
    if options.empty_as_null:
        return F.when(c != "", c)
    ended = F.lit(True)
    for k in range(i, width):
        ended = ended & F.col(f"c{k}").isNull()
    return F.when(c.isNull() & F.col(_BROKEN).isNotNull() & ended, F.lit(None)).otherwise(F.coalesce(c, F.lit("")))


def csv_cell(c: Column, kind: T.DataType) -> Column:
    """A cell as CSV text: null, NaN and infinities empty, dates without time where they have none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(20,0)").cast("string"))
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.coalesce(whole, c.cast("string")))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        midnight = F.date_format(c, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
        return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    return c.cast("string")


def write_csv(frame: Frame, path: str, options: CsvOptions | None = None, one_file: bool = True) -> None:
    """Write a frame with a header, in its order; into one file, or a folder of files for frames beyond one task."""
    options = CsvOptions.of(options)
    ordered = frame.data.orderBy(*frame.order_names()) if frame.order_names() else frame.data
    text = ordered.select(*[csv_cell(named(n), frame.type_of(n)).alias(n) for n in frame.column_names])

    def write(data: DataFrame, where: str) -> None:
        data.write.mode("overwrite").csv(
            where, header=options.has_header, sep=options.delimiter, quote=options.quote, escape=options.quote, encoding=options.encoding, emptyValue="", nullValue="", quoteAll=False,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )

    if one_file:
        single_file(text, path, write)
    else:
        write(text, path)

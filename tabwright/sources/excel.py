"""Excel workbooks (.xlsx): one sheet, read and written with the standard library.

A workbook is a zip of XML that only one process can read and whose format ends at
1,048,576 rows, so the driver packs and unpacks it; typing is Spark's.
"""

from __future__ import annotations

import datetime as dt
import io
import math
import re
import zipfile
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.names import named
from tabwright.frame import Frame
from tabwright.operators.position import with_scan_position
from tabwright.sources.csv import normalize_headers
from tabwright.sources.files import read_bytes, write_bytes
from tabwright.sources.inference import Cell, infer
from tabwright.sources.options import ExcelOptions, LoadOptions

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 702
_NS = {"m": MAIN}
#: Number formats that show dates. Fixed values.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def column_letters(index: int) -> str:
    """A, ..., Z, AA, ... for 0, 1, ..."""
    if not 0 <= index < MOST_COLUMNS:
        raise ValueError(f"column {index} is beyond ZZ")
    high, low = divmod(index, 26)
    return (chr(64 + high) if high else "") + chr(65 + low)


def column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        index = index * 26 + ord(letter) - 64
    return index - 1


def _text(node: ElementTree.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{{{MAIN}}}t"))


def _serial_time(serial: float) -> str:
    return (dt.datetime(1899, 12, 30) + dt.timedelta(days=serial)).strftime("%Y-%m-%d %H:%M:%S")


def read_sheet(content: bytes, which: str | int = 0) -> list[list[tuple[str, str] | None]]:
    """Rows of a sheet, by its name or its number from 0: (text, number | string | other) or None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iterfind("m:numFmts/m:numFmt", _NS) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            dates = {i for i, x in enumerate(styles.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}
        sheet = ElementTree.fromstring(book.read(_sheet_part(book, which)))
    rows = []
    for row in sheet.iterfind("m:sheetData/m:row", _NS):
        cells: list[tuple[str, str] | None] = []
        for c in row.findall("m:c", _NS):
            at = column_index(c.get("r")) if c.get("r") else len(cells)
            cells.extend([None] * (at - len(cells) + 1))
            kind, value = c.get("t", "n"), c.find("m:v", _NS)
            if kind == "inlineStr":
                cells[at] = (_text(c.find("m:is", _NS)), "string")
            elif value is not None and value.text is not None:
                if kind == "s":
                    cells[at] = (shared[int(value.text)], "string")
                elif kind == "b":
                    cells[at] = ("True" if value.text == "1" else "False", "other")
                elif kind == "n" and int(c.get("s", 0)) in dates:
                    cells[at] = (_serial_time(float(value.text)), "string")
                else:
                    cells[at] = (value.text, "number" if kind == "n" else "string")
        rows.append(cells)
    return rows


def _sheet_part(book: zipfile.ZipFile, which: str | int) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
    found = [s for i, s in enumerate(sheets) if which in (i, s.get("name"))]
    if not found:
        raise ValueError(f"no sheet {which!r}; there are {', '.join(s.get('name', '') for s in sheets)}")
    first = found[0]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == first.get(f"{{{OFFICE}}}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def load_excel(spark: SparkSession, path: str, options: LoadOptions | None = None, sheet: str | int = 0) -> Frame:
    """A frame of a sheet of a workbook, by its name or its number from 0; rows without any cell are passed over, and an empty sheet is an error."""
    if path.lower().endswith(".xls"):
        raise ValueError("the binary .xls format isn't supported; save the workbook as .xlsx")
    options = options or LoadOptions()
    rows = [r for r in read_sheet(read_bytes(spark, path), sheet) if any(c is not None and c[0] != "" for c in r)]
    if not rows:
        raise ValueError(f"{path} is empty")
    width = max(len(rows[0]), 1) if options.has_header else max(map(len, rows))
    head = [c[0] if c else None for c in rows[0]]
    names = normalize_headers(head + [None] * (width - len(head))) if options.has_header else [f"Column{i}" for i in range(width)]
    body = rows[1:] if options.has_header else rows
    fields = [T.StructField(f"{p}{i}", T.StringType()) for i in range(width) for p in ("t", "k")]
    flat = [tuple(x for i in range(width) for x in (r[i] if i < len(r) and r[i] is not None else (None, None))) for r in body]
    data = with_scan_position(spark.createDataFrame(flat, T.StructType(fields)))
    return infer(data, {n: Cell(F.col(f"t{i}"), F.col(f"k{i}")) for i, n in enumerate(names)}, options.categorical_threshold)


def _cell_xml(reference: str, value: Any) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return ""
    if isinstance(value, bool):
        value = "TRUE" if value else "FALSE"
    elif isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    elif isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value), {chr(34): "&quot;"})}</t></is></c>'


def write_excel(frame: Frame, path: str, options: ExcelOptions | None = None) -> None:
    """Write a frame as the one sheet of a workbook, in its order; ``.xlsx`` is appended where it lacks.

    Numbers stay numbers; times, booleans and text are text; null, NaN and
    infinities are no cells. Rows beyond the format's limit are an error.
    """
    options = options or ExcelOptions()
    path = path if path.lower().endswith(".xlsx") else f"{path}.xlsx"
    names = frame.column_names
    letters = [column_letters(i) for i in range(len(names))]
    ordered = frame.data.orderBy(*frame.order_names()) if frame.order_names() else frame.data
    rows = ordered.select(*[named(n) for n in names]).limit(MOST_ROWS).collect()
    if len(rows) >= MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows and a header")
    lines = [f'<row r="{r}">{"".join(_cell_xml(f"{a}{r}", v) for a, v in zip(letters, cells, strict=True))}</row>' for r, cells in enumerate([names, *rows], 1)]
    last = f"{letters[-1] if letters else 'A'}{len(rows) + 1}"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="{escape(options.sheet_name, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{MAIN}"><dimension ref="A1:{last}"/><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as book:
        for name, xml in parts.items():
            book.writestr(name, xml)
    write_bytes(frame.data.sparkSession, path, content.getvalue())

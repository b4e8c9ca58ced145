"""Excel workbooks, read with the standard library: cells, shared strings and date styles."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InvalidFormat, InvalidStructure

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Numbers of the built-in date and time formats (fixed values).
DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))


def _check(path: str) -> None:
    if not path.lower().endswith((".xlsx", ".xls")):
        raise InvalidFormat(f"not an Excel file: {path}", path=path)


def _open(path: str) -> zipfile.ZipFile:
    _check(path)
    try:
        return zipfile.ZipFile(path)
    except (zipfile.BadZipFile, OSError) as e:
        raise InvalidStructure(f"the workbook cannot be read: {path}", path=path) from e


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    try:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
    except (KeyError, ET.ParseError) as e:
        raise InvalidStructure("the workbook has no sheets") from e
    return [(s.get("name"), "xl/" + targets[s.get(f"{_REL}id")].removeprefix("/xl/")) for s in book.iter(f"{_MAIN}sheet")]


def sheet_names(path: str) -> list[str]:
    with _open(path) as z:
        return [name for name, _ in _sheets(z)]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows(path: str, sheet: str | None = None) -> Iterator[list]:
    """The rows of a sheet (the first by default) as lists of text, float, bool, datetime or None."""
    with _open(path) as z:
        sheets = _sheets(z)
        found = next((t for n, t in sheets if n == sheet), None) if sheet else sheets[0][1] if sheets else None
        if found is None:
            raise InvalidStructure(f"no sheet {sheet!r} in {path}", path=path, sheet=sheet)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(z)
        try:
            with z.open(found) as f:
                for _, row in ET.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    out: list = []
                    for c in row.iter(f"{_MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else len(out)
                        out += [None] * (at + 1 - len(out))
                        out[at] = _value(c, shared, dates)
                    yield out
                    row.clear()
        except (ET.ParseError, KeyError) as e:
            raise InvalidStructure(f"the sheet cannot be read: {path}", path=path) from e


def _value(c: ET.Element, shared: list[str], dates: set[int]):
    kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    if v is None:
        return None
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return v == "1"
    if kind in ("str", "d"):
        return v
    if kind == "e":
        return None
    if int(c.get("s", 0)) in dates:
        return datetime(1899, 12, 30) + timedelta(microseconds=round(float(v) * 86_400_000_000))
    return float(v)


def _columns(header: list) -> list[str]:
    return [str(h) if h is not None else f"column_{i}" for i, h in enumerate(header)]


def infer(path: str, sheet: str | None = None, na_values: tuple[str, ...] = ()) -> str:
    """A schema (DDL) from all rows under the header: bigint, double, boolean, timestamp_ntz or string."""
    it = rows(path, sheet)
    header = next(it, None)
    if not header:
        raise InvalidStructure(f"the sheet is empty: {path}", path=path)
    kinds: list[set] = [set() for _ in header]
    for row in it:
        for i, v in enumerate(row[: len(header)]):
            if v is not None and v not in na_values:
                kinds[i].add("long" if isinstance(v, float) and v.is_integer() else {float: "double", bool: "boolean", datetime: "timestamp_ntz", str: "string"}[type(v)])
    one = lambda k: "double" if k == {"long", "double"} else next(iter(k)) if len(k) == 1 else "string"
    return ", ".join(f"`{c}` {one(k)}" for c, k in zip(_columns(header), kinds, strict=True))


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.sheet = schema, options["path"], options.get("sheet")
        self.na = tuple(x for x in options.get("na", "").split("\x1f") if x)

    def partitions(self):
        return [InputPartition(0)]  # a sheet is one compressed stream

    def read(self, partition):
        kinds = [f.dataType.typeName() for f in self.schema.fields]
        it = rows(self.path, self.sheet)
        next(it, None)
        for row in it:
            yield tuple(self._cast(row[i] if i < len(row) else None, k) for i, k in enumerate(kinds))

    def _cast(self, v, kind: str):
        if v is None or v == "" or v in self.na:
            return None
        if kind == "long":
            return int(v)
        if kind == "string":
            return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
        return v


class XlsxDataSource(DataSource):
    """``spark.read.format("xlsx")`` with options path, sheet and na."""

    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return infer(self.options["path"], self.options.get("sheet"), tuple(x for x in self.options.get("na", "").split("\x1f") if x))

    def reader(self, schema):
        return _Reader(schema, self.options)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, na_values: tuple[str, ...] = ()) -> DataFrame:
    """A sheet with its header row as a table. Workbooks of the old binary format are not read."""
    if path.lower().endswith(".xls"):
        raise InvalidStructure(f"old binary workbooks are not read; save {path} as .xlsx", path=path)
    sheet_names(path)  # a broken workbook is an error here, not inside a task
    from ..session import ship

    ship(spark)
    spark.dataSource.register(XlsxDataSource)
    reader = spark.read.format("xlsx").option("path", path)
    if sheet:
        reader = reader.option("sheet", sheet)
    if na_values:
        reader = reader.option("na", "\x1f".join(na_values))
    return reader.load()


def write_xlsx(path: str, sheets: dict[str, list[list]], frozen_columns: int = 0, highlight: dict[str, str] | None = None) -> None:
    """A small report workbook: bold header, frozen first row and columns, rows filled by the value of ``difference_type``.

    ``highlight`` maps difference types to RGB colours.
    """
    from xml.sax.saxutils import escape, quoteattr

    fills = list((highlight or {}).items())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{2 + len(fills)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>' + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for _, c in fills) + f'</fills><borders count="1"><border/></borders><cellXfs count="{2 + len(fills)}"><xf/><xf fontId="1" applyFont="1"/>' + "".join(f'<xf fillId="{i + 2}" applyFill="1"/>' for i in range(len(fills))) + "</cellXfs></styleSheet>")
        styles = {k: i + 2 for i, (k, _) in enumerate(fills)}
        for i, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="1"{f' xSplit="{frozen_columns}"' if frozen_columns else ""} topLeftCell="{chr(65 + frozen_columns)}2" state="frozen"/></sheetView></sheetViews>'
                f.write(f'<?xml version="1.0"?><worksheet xmlns="{_MAIN[1:-1]}">{pane}<sheetData>'.encode())
                for n, row in enumerate(sheets[name]):
                    style = 1 if n == 0 else next((styles[v] for v in row if isinstance(v, str) and v in styles), 0)
                    cells = "".join("<c/>" if v is None else f'<c s="{style}" t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f'<c s="{style}"><v>{v}</v></c>' if isinstance(v, (int, float)) and v == v and abs(v) != float("inf") else f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in row)
                    f.write(f"<row>{cells}</row>".encode())
                f.write(b"</sheetData></worksheet>")

"""Python data sources for SQLite files and spreadsheets, on the standard library alone."""

from __future__ import annotations

import base64
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)  # never writes, whatever the query


def list_tables(path: str) -> list[str]:
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY lower(name)")]


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    return str(value).strip()


class SqliteSource(DataSource):
    """Options: path, and query or table.  A table is read in ranges of rowid, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def sql(self) -> str:
        if "query" in self.options:
            return self.options["query"]
        return 'SELECT * FROM "' + self.options["table"].replace('"', '""') + '"'

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as db:
            names = [d[0].strip() for d in db.execute(f"SELECT * FROM ({self.sql()}) LIMIT 0").description]
        return T.StructType([T.StructField(n or f"Column {i + 1}", T.StringType()) for i, n in enumerate(names)])

    def reader(self, schema: T.StructType) -> "SqliteReader":
        return SqliteReader(self.options["path"], self.sql(), self.options.get("table"), int(self.options.get("numpartitions", "1")))


class Span(InputPartition):
    def __init__(self, lo: int | None, hi: int | None):
        super().__init__(lo)
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, sql: str, table: str | None, parts: int):
        self.path, self.sql, self.table, self.parts = path, sql, table, parts

    def partitions(self) -> list[InputPartition]:
        if not self.table or self.parts < 2:
            return [Span(None, None)]
        with _open(self.path) as db:
            try:
                lo, hi = db.execute('SELECT min(rowid), max(rowid) FROM "' + self.table.replace('"', '""') + '"').fetchone()
            except sqlite3.OperationalError:  # a table without rowid
                return [Span(None, None)]
        if lo is None:
            return []
        step = -(-(hi - lo + 1) // self.parts)
        return [Span(a, a + step) for a in range(lo, hi + 1, step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        with _open(self.path) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            ranged = partition.lo is not None
            rows = db.execute(self.sql + (" WHERE rowid >= ? AND rowid < ?" if ranged else ""), (partition.lo, partition.hi) if ranged else ())
            for row in rows:
                yield tuple(map(_text, row))


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_OT = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_OO = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_OX = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _plain_number(text: str) -> str:
    """A number without a fraction has no decimals."""
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _xlsx_sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    root = ET.fromstring(book.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in root.iter(f"{_S}sheet"):
        target = links[s.get(f"{_R}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx_rows(book: zipfile.ZipFile, part: str) -> Iterator[list[str]]:
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    with book.open(part) as f:
        for _, row in ET.iterparse(f):
            if row.tag != f"{_S}row":
                continue
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                v, kind = c.find(f"{_S}v"), c.get("t")
                raw = "" if v is None else v.text or ""
                if kind == "s":
                    text = shared[int(raw)].strip()
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")).strip()
                elif kind == "b":
                    text = "true" if raw == "1" else "false"
                elif kind == "e":
                    text = ""
                else:
                    text = raw.strip() if kind == "str" else _plain_number(raw)
                cells[at] = text
            yield cells
            row.clear()


def _ods_rows(book: zipfile.ZipFile, sheet: str) -> Iterator[list[str]]:
    root = ET.fromstring(book.read("content.xml"))
    table = next(t for t in root.iter(f"{_OT}table") if t.get(f"{_OT}name") == sheet)
    for row in table.iter(f"{_OT}table-row"):
        cells: list[str] = []
        blanks = 0  # only those before a value count, however many
        for c in row.iter(f"{_OT}table-cell"):
            kind = c.get(f"{_OO}value-type")
            text = "\n".join("".join(p.itertext()) for p in c.iter(f"{_OX}p")).strip()
            if kind in ("float", "currency", "percentage"):
                text = _plain_number(c.get(f"{_OO}value", text))
            elif kind == "boolean":
                text = c.get(f"{_OO}boolean-value", text)
            times = int(c.get(f"{_OT}number-columns-repeated", "1"))
            if text:
                cells += [""] * blanks + [text] * times
            blanks = 0 if text else blanks + times
        for _ in range(int(row.get(f"{_OT}number-rows-repeated", "1")) if cells else 1):
            yield list(cells)


def list_sheets(path: str) -> list[str]:
    with zipfile.ZipFile(path) as book:
        if "content.xml" in book.namelist():
            return [t.get(f"{_OT}name") for t in ET.fromstring(book.read("content.xml")).iter(f"{_OT}table")]
        return [n for n, _ in _xlsx_sheets(book)]


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list[str]]:
    with zipfile.ZipFile(path) as book:
        ods = "content.xml" in book.namelist()
        names = list_sheets(path)
        if not names or (sheet is not None and sheet not in names):
            raise ValueError(f"sheet {sheet!r} not found in {path}")
        name = sheet if sheet is not None else names[0]
        yield from _ods_rows(book, name) if ods else _xlsx_rows(book, dict(_xlsx_sheets(book))[name])


class WorkbookSource(DataSource):
    """Options: path, sheet, header.  One partition: a sheet is one compressed stream."""

    @classmethod
    def name(cls) -> str:
        return "workbook_rows"

    def _names(self) -> list[str]:
        rows = list(sheet_rows(self.options["path"], self.options.get("sheet")))
        width = max((len(r) for r in rows), default=0)
        head = rows[0] if rows and self.options.get("header", "true") == "true" else []
        return [(head[i].strip() if i < len(head) else "") or f"Column {i + 1}" for i in range(width)]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self._names()])

    def reader(self, schema: T.StructType) -> "WorkbookReader":
        return WorkbookReader(self.options["path"], self.options.get("sheet"), self.options.get("header", "true") == "true", len(schema.fields))


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, header: bool, width: int):
        self.path, self.sheet, self.header, self.width = path, sheet, header, width

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k, row in enumerate(sheet_rows(self.path, self.sheet)):
            if k or not self.header:
                yield tuple([*row, *[""] * (self.width - len(row))])

"""XLSX in and out, by the standard library.

Reading goes through Spark's binaryFile source, so files may lie anywhere Spark reads; one task parses a file and gives the long form of its cells. Sheet, row and column bounds stop the parser early. Writing streams rows through the driver into one file, as the format asks for, and puts it where Spark's file systems reach.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.parser import parse, shift, show
from lattica.refs import MAX_COLS, MAX_ROWS, col_letters, parse_ref
from lattica.sheet import Sheet

SCHEMA = "path string, sheet string, _row long, _col int, kind string, num double, txt string, bool boolean, ts timestamp_ntz, err string, formula string"
#: Built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57}
LIMITS = {"ratio": 100, "bytes": 100_000_000, "entries": 10_000, "cells": 10_000_000, "text": 32_768}


class LimitExceeded(ValueError):
    """A file larger than the reader's limits; a limit of 0 is none."""


def tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def opened(data: bytes, limits: dict[str, int]) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    size = sum(i.file_size for i in infos)
    if limits["entries"] and len(infos) > limits["entries"]:
        raise LimitExceeded(f"{len(infos)} entries")
    if limits["bytes"] and size > limits["bytes"]:
        raise LimitExceeded(f"{size} bytes")
    if limits["ratio"] and any(i.file_size > 100_000 and i.file_size > limits["ratio"] * max(1, i.compress_size) for i in infos):
        raise LimitExceeded("compression ratio")
    return z


def attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def sheet_list(z: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, part) of each sheet, and whether dates count from 1904."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    rels = {r.attrib["Id"]: r.attrib["Target"] for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out, old = [], False
    for e in book.iter():
        if tag(e) == "workbookPr":
            old = attribute(e, "date1904") in ("1", "true")
        if tag(e) == "sheet":
            target = rels[attribute(e, "id")]
            out.append((e.attrib["name"], target.lstrip("/") if target.startswith("/") else "xl/" + target))
    return out, old


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter() if tag(t) == "t" ) for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Style numbers that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(e.attrib["numFmtId"]): e.attrib.get("formatCode", "") for e in root.iter() if tag(e) == "numFmt"}
    dated = lambda i: i in DATE_FORMATS or (i in own and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own[i]), re.I) is not None)
    xfs = next((e for e in root if tag(e) == "cellXfs"), [])
    return {k for k, x in enumerate(xfs) if dated(int(x.attrib.get("numFmtId", 0)))}


def moment(serial: float, old: bool) -> datetime:
    base = datetime(1904, 1, 1) if old else datetime(1899, 12, 30) + timedelta(days=1 if serial < 60 else 0)
    return base + timedelta(microseconds=round(serial * 86_400_000_000))


def cells(z: zipfile.ZipFile, part: str, strings: list[str], dated: set[int], old: bool, rows: tuple[int, int] | None, cols: tuple[int, int] | None, limits: dict[str, int]) -> Iterator[tuple]:
    """(row, col, kind, num, txt, bool, ts, err, formula) of each cell; stops after the last row asked for."""
    shared: dict[str, tuple[str, int, int]] = {}
    row = col = seen = 0
    with z.open(part) as f:
        for event, e in ET.iterparse(f, events=("start", "end")):
            name = tag(e)
            if event == "start":
                if name == "row":
                    row, col = int(e.attrib.get("r", row + 1)), 0
                    if rows and row > rows[1]:
                        return
                continue
            if name == "row":
                e.clear()
            if name != "c":
                continue
            at = parse_ref(e.attrib["r"]) if "r" in e.attrib else None
            r, col = (at.row, at.col) if at else (row, col + 1)
            parts = {tag(x): x for x in e}
            formula = None
            if (x := parts.get("f")) is not None:
                formula, si = x.text, x.attrib.get("si")
                if x.attrib.get("t") == "shared" and formula:
                    shared[si] = (formula, r, col)
                elif x.attrib.get("t") == "shared" and si in shared:
                    text, r0, c0 = shared[si]
                    formula = show(shift(parse(text), r - r0, col - c0))
            if (rows and r < rows[0]) or (cols and not cols[0] <= col <= cols[1]):
                continue
            seen += 1
            if limits["cells"] and seen > limits["cells"]:
                raise LimitExceeded(f"more than {limits['cells']} cells")
            kind, raw = e.attrib.get("t", "n"), parts["v"].text if "v" in parts else None
            num = txt = flag = ts = err = None
            if kind == "s" and raw is not None:
                txt = strings[int(raw)]
            elif kind == "inlineStr":
                txt = "".join(t.text or "" for t in parts["is"].iter() if tag(t) == "t") if "is" in parts else ""
            elif kind == "str":
                txt = raw or ""
            elif kind == "b" and raw is not None:
                flag = raw == "1"
            elif kind == "e":
                err = raw
            elif kind == "d" and raw:
                ts = datetime.fromisoformat(raw)
            elif raw is not None:
                num = float(raw)
                if int(e.attrib.get("s", 0)) in dated:
                    num, ts = None, moment(float(raw), old)
            if txt is not None and limits["text"] and len(txt) > limits["text"]:
                raise LimitExceeded("a text is too long")
            what = "text" if txt is not None else "bool" if flag is not None else "error" if err else "date" if ts else "num" if num is not None else "formula" if formula else None
            if what:
                yield r, col, what, num, txt, flag, ts, err, formula


def read_cells(spark: SparkSession, path: str, sheet: str | int | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, **limits: int) -> DataFrame:
    """The long form of one file's or many files' cells. sheet: a name, a 0-based index or all."""
    limit = LIMITS | limits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                z = opened(data.as_py(), limit)
                sheets, old = sheet_list(z)
                strings, dated = shared_strings(z), date_styles(z)
                some: list[tuple] = []
                for i, (name, part) in enumerate(sheets):
                    if sheet is not None and sheet not in (i, name) and not (isinstance(sheet, str) and sheet.lower() == name.lower()):
                        continue
                    for c in cells(z, part, strings, dated, old, rows, cols, limit):
                        some.append((p, name, *c))
                        if len(some) == 8192:
                            yield arrow(some)
                            some = []
                yield arrow(some)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, SCHEMA)


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.timestamp("us"), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def whole_file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def sheets_of(spark: SparkSession, path: str) -> list[str]:
    """Sheet names, without cell data."""
    return [n for n, _ in sheet_list(opened(whole_file(spark, path), LIMITS))[0]]


def metadata(spark: SparkSession, path: str) -> dict:
    """Without cell data: sheets with the dimension that each states (None where it states none), and defined names with their sheets (None for the workbook's)."""
    z = opened(whole_file(spark, path), LIMITS)
    sheets = []
    for name, part in sheet_list(z)[0]:
        with z.open(part) as f:
            head = f.read(1 << 16)  # the dimension stands before the rows
        m = re.search(rb'<(?:\w+:)?dimension\b[^>]*\bref="([^"]*)"', head)
        sheets.append((name, m[1].decode() if m else None))
    names = []
    for e in ET.fromstring(z.read("xl/workbook.xml")).iter():
        if tag(e) == "definedName":
            own = e.attrib.get("localSheetId")
            names.append((e.attrib["name"], e.text or "", sheets[int(own)][0] if own is not None else None))
    return {"sheets": sheets, "names": names}


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, header: bool = True, **options) -> Sheet:
    """The wide form: a column for each used column, typed where its cells agree, else as text."""
    long = read_cells(spark, path, sheet, **options)
    body = long.where(F.col("_row") > 1) if header else long
    used = [(r._col, sorted(r.kinds), r.head) for r in long.groupBy("_col").agg(F.collect_set(F.when((F.col("_row") > 1) | F.lit(not header), F.col("kind"))).alias("kinds"), F.max(F.when(F.col("_row") == 1, F.coalesce("txt", F.col("num").cast("string")))).alias("head")).orderBy("_col").collect()]  # a row per sheet column
    shown = F.coalesce("txt", F.col("num").cast("string"), F.upper(F.col("bool").cast("string")), F.col("ts").cast("string"), "err")
    value = {("num",): F.col("num"), ("bool",): F.col("bool"), ("date",): F.col("ts")}
    names, aggs = [], []
    for c, kinds, head in used:
        name = head if header and head and head not in names else col_letters(c)
        names.append(name)
        aggs.append(F.first(F.when(F.col("_col") == c, value.get(tuple(k for k in kinds if k != "formula"), shown)), ignorenulls=True).alias(name))
    row = (F.col("_row") - int(header)).alias("_row")
    df = body.groupBy(row).agg(*aggs) if aggs else body.select(row)
    return Sheet(str(sheet), df, names, "_row")


class _Stream(io.RawIOBase):
    """A new file on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.to = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.to.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.to.close()
        super().close()


def created(spark: SparkSession, path: str) -> io.BufferedWriter:
    return io.BufferedWriter(_Stream(spark, path), 1 << 20)


def cell_xml(ref: str, x: object, guard: bool, formula: str | None = None, style: str | None = None) -> str:
    """One cell; with a formula, x is its cached value."""
    f = "" if formula is None else f"<f>{escape(formula.removeprefix('='))}</f>"
    s = "" if style is None else f' s="{style}"'
    if x is None:
        return f'<c r="{ref}"{s}>{f}</c>' if f else ""
    if isinstance(x, bool):
        return f'<c r="{ref}"{s} t="b">{f}<v>{int(x)}</v></c>'
    if isinstance(x, int | float):
        return f'<c r="{ref}"{s}>{f}<v>{x!r}</v></c>'
    if isinstance(x, datetime | date):
        at = x.replace(tzinfo=None) if isinstance(x, datetime) else datetime(x.year, x.month, x.day)
        days = (at - datetime(1899, 12, 30)) / timedelta(days=1)
        return f'<c r="{ref}"{s or (" s=" + chr(34) + "1" + chr(34))}>{f}<v>{days!r}</v></c>'
    text = str(x)
    if guard and not f and text[:1] in "=+-@":
        text = "'" + text
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    if f:
        return f'<c r="{ref}"{s} t="str">{f}<v>{escape(text)}</v></c>'
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(sheets: dict[str, DataFrame], path: str, header: bool = True, order: str | None = "_row", guard: bool = True, formulas: dict[str, dict[str, str]] | None = None, names: dict[str, str] | None = None, dimension: bool = False) -> None:
    """One workbook of the given sheets, streamed to wherever Spark writes; rows in the order of `order` where it exists. guard: texts that a spreadsheet would take for formulas get an apostrophe. formulas: sheet -> column -> formula as in that column's first data row; its cells' values are cached beside it. names: defined names. dimension: rows are counted first, so that each sheet states its dimension before its cells."""
    spark = next(iter(sheets.values())).sparkSession
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    defined = "".join(f"<definedName name={quoteattr(n)}>{escape(t.removeprefix('='))}</definedName>" for n, t in (names or {}).items())
    with created(spark, path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets>" + (f"<definedNames>{defined}</definedNames>" if defined else "") + "</workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="rId0" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, (name, df) in enumerate(sheets.items(), 1):
            columns = [c for c in df.columns if c != order]
            if len(columns) > MAX_COLS:
                raise ValueError("more columns than a sheet holds")
            rows = (df.orderBy(order) if order in df.columns else df).select(*[F.col(f"`{c}`") for c in columns])
            letters = [col_letters(k) for k in range(1, len(columns) + 1)]
            trees = {c: parse(f) for c, f in (formulas or {}).get(name, {}).items()}
            first = 1 + int(header)
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                f.write(f'<worksheet xmlns="{main}">'.encode())
                if dimension and columns:
                    last = max(df.count() + int(header), 1)
                    f.write(f'<dimension ref="A1:{letters[-1]}{last}"/>'.encode())
                f.write(b"<sheetData>")
                n = 0
                if header:
                    n = 1
                    f.write((f'<row r="{n}">' + "".join(cell_xml(f"{a}{n}", x, guard) for a, x in zip(letters, columns, strict=True)) + "</row>").encode())
                for r in rows.toLocalIterator(prefetchPartitions=True):
                    n += 1
                    if n > MAX_ROWS:
                        raise ValueError("more rows than a sheet holds")
                    f.write((f'<row r="{n}">' + "".join(cell_xml(f"{a}{n}", x, guard, show(shift(trees[c], n - first)) if c in trees else None) for a, c, x in zip(letters, columns, r, strict=True)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")


ROW = re.compile(rb'<((?:\w+:)?)row\b([^>]*?)(?:/>|>(.*?)</(?:\w+:)?row>)', re.S)
CELL = re.compile(r'<(?:\w+:)?c\b([^>]*?)(?:/>|>.*?</(?:\w+:)?c>)', re.S)


def patched_row(number: int, attributes: str, body: str, patches: dict[int, object], guard: bool) -> str:
    """A row with some of its cells set anew; a cell keeps its style, a row its attributes."""
    cells: dict[int, str] = {}
    styles: dict[int, str] = {}
    at = 0
    for m in CELL.finditer(body):
        ref = re.search(r'\br="([A-Z]+)\d+"', m[1])
        at = parse_ref(ref[1] + "1").col if ref else at + 1
        cells[at] = m[0]
        if style := re.search(r'\bs="(\d+)"', m[1]):
            styles[at] = style[1]
    for col, x in patches.items():
        formula = x if isinstance(x, str) and x.startswith("=") else None
        cells[col] = cell_xml(f"{col_letters(col)}{number}", None if formula else x, guard, formula, styles.get(col)) or (f'<c r="{col_letters(col)}{number}" s="{styles[col]}"/>' if col in styles else "")
    return f"<row{attributes}>" + "".join(cells[c] for c in sorted(cells)) + "</row>"


def transform_xlsx(spark: SparkSession, source: str, target: str, sheet: str | int, patches: dict[str, object], guard: bool = True) -> None:
    """A copy of a workbook in which some cells of a sheet are set anew (a text that begins with = is a formula, None empties). Rows without a patch are copied byte by byte, other parts as they are; cached values of other formulas are left as they were."""
    by_row: dict[int, dict[int, object]] = {}
    for ref, x in patches.items():
        r = parse_ref(ref)
        by_row.setdefault(r.row, {})[r.col] = x
    z = opened(whole_file(spark, source), LIMITS)
    part = next((p for i, (n, p) in enumerate(sheet_list(z)[0]) if sheet == i or (isinstance(sheet, str) and sheet.lower() == n.lower())), None)
    if part is None:
        raise ValueError(f"no sheet {sheet}")
    with created(spark, target) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in z.infolist():
            if info.filename != part:
                new.writestr(info.filename, z.read(info))
                continue
            data = z.read(info)
            data = re.sub(rb"<((?:\w+:)?)sheetData\s*/>", rb"<\1sheetData></\1sheetData>", data, count=1)
            head = re.search(rb"<((?:\w+:)?)sheetData\b[^>]*>", data)
            if head[1]:
                raise ValueError("a sheet with prefixed elements")
            left = sorted(by_row)
            with new.open(part, "w", force_zip64=True) as f:
                f.write(data[: head.end()])
                at, number = head.end(), 0
                end = data.index(b"</sheetData>", at)
                for m in ROW.finditer(data, at, end):
                    own = re.search(rb'\br="(\d+)"', m[2])
                    number = int(own[1]) if own else number + 1
                    while left and left[0] < number:
                        f.write(patched_row(left[0], f' r="{left[0]}"', "", by_row[left.pop(0)], guard).encode())
                    if left and left[0] == number:
                        f.write(patched_row(number, m[2].decode() or f' r="{number}"', (m[3] or b"").decode(), by_row[left.pop(0)], guard).encode())
                    else:
                        f.write(m[0])
                for r in left:
                    f.write(patched_row(r, f' r="{r}"', "", by_row[r], guard).encode())
                f.write(data[end:])

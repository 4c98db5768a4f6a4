"""Workbooks (xlsx): rows of a sheet from file content, and content from the rows of a table.

Spark has no source for workbooks, so tables of (path, content), as ``binaryFile`` reads them
from any file system, are parsed in tasks. A file is one zip and is read by one task, as a stream
of rows; a task holds the file, its list of shared texts and one batch of rows (Spark puts small files
together up to ``spark.sql.files.maxPartitionBytes``). Many files are
dealt to many tasks. The format ends at 2^20 rows a sheet; ``pack`` begins a new file before.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearlog.sources.storage import materialised

ORIGIN = dt.datetime(1899, 12, 30)
#: Fixed value: days between the two date systems of workbooks.
SHIFT_1904 = 1462
#: Number formats of the standard that show a date.
DATE_FORMATS = frozenset((14, 15, 16, 17, 22))
#: Fixed value: most rows a sheet may have.
MOST_ROWS = 1 << 20
#: Cells of a batch of rows.
BATCH_CELLS = 100_000
#: Namespaces of workbook parts.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT = "http://schemas.openxmlformats.org/package/2006/content-types"
HEX = re.compile(r"_x([0-9A-Fa-f]{4})_")
#: Characters that a cell cannot hold as they are, and texts that look like their replacement.
UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
LITERAL = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _plain(text: str) -> str:
    return HEX.sub(lambda m: chr(int(m[1], 16)), text)


def _joined(element: ElementTree.Element) -> str:
    """Text of a cell or shared text: its runs, without phonetic guides."""
    parts = []
    for child in element:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts.append(_joined(child))
    return _plain("".join(parts)) if _local(element.tag) != "r" else "".join(parts)


def _part(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.NameToInfo else None


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> tuple[str, int]:
    """The part that holds a sheet (the first one if None) and the shift of the book's days."""
    root = _part(book, "xl/workbook.xml")
    relations = _part(book, "xl/_rels/workbook.xml.rels")
    if root is None or relations is None:
        raise ValueError("not a workbook")
    targets = {r.get("Id"): r.get("Target") for r in relations}
    named = [(s.get("name"), targets.get(s.get(f"{{{RELATIONS}}}id"))) for s in root.iter(f"{{{MAIN}}}sheet")]
    found = [target for name, target in named if target and (sheet is None or name == sheet)]
    if not found:
        raise ValueError(f"no sheet {sheet!r} among {[name for name, _ in named]}")
    properties = root.find(f"{{{MAIN}}}workbookPr")
    shifted = properties is not None and properties.get("date1904") in ("1", "true")
    return (found[0].lstrip("/") if found[0].startswith("/") else f"xl/{found[0]}"), SHIFT_1904 if shifted else 0


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.NameToInfo:
        return []
    texts = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, element in ElementTree.iterparse(part):
            if _local(element.tag) == "si":
                texts.append(_joined(element))
                element.clear()
    return texts


def _date_styles(book: zipfile.ZipFile) -> frozenset[int]:
    """Numbers of the cell styles that show a date."""
    root = _part(book, "xl/styles.xml")
    if root is None:
        return frozenset()
    dates = set(DATE_FORMATS)
    for f in root.iter(f"{{{MAIN}}}numFmt"):
        if re.search("[yd]", LITERAL.sub("", f.get("formatCode", "")), re.IGNORECASE):
            dates.add(int(f.get("numFmtId")))
    styles = root.find(f"{{{MAIN}}}cellXfs")
    return frozenset(i for i, xf in enumerate([] if styles is None else styles) if int(xf.get("numFmtId", 0)) in dates)


def _column(reference: str) -> int:
    at = 0
    for letter in reference:
        if not letter.isalpha():
            break
        at = at * 26 + ord(letter.upper()) - 64
    return at - 1


def _number(text: str, shift: int, is_date: bool, header: bool) -> str:
    """A number as text; days as yyyy-MM-dd, in the header as a day number of the 1900 system."""
    value = float(text)
    if not is_date:
        return str(int(value)) if value.is_integer() and abs(value) < 2**53 else repr(value)
    value += shift
    if header:
        return str(int(value))
    day = ORIGIN + dt.timedelta(seconds=round(value * 86400))
    return day.date().isoformat() if day.time() == dt.time() else day.isoformat(" ")


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """Row number (from 1) and cells as text of each row of a sheet; booleans are true and false.

    Cells without a value, and cells that hold an error, are None. The first row present is the header.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part, shift = _sheet_part(book, sheet)
        shared, dates = _shared(book), _date_styles(book)
        number, header = 0, True
        with book.open(part) as stream:
            events = ElementTree.iterparse(stream, events=("start", "end"))
            holder = None
            for event, element in events:
                kind = _local(element.tag)
                if event == "start":
                    holder = element if kind == "sheetData" else holder
                    continue
                if kind != "row":
                    continue
                number = int(element.get("r", number + 1))
                cells: list[str | None] = []
                for cell in element:
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    cells[at] = _cell(cell, shared, dates, shift, header)
                yield number, cells
                header = False
                if holder is not None:
                    holder.clear()


def _cell(cell: ElementTree.Element, shared: list[str], dates: frozenset[int], shift: int, header: bool) -> str | None:
    kind = cell.get("t", "n")
    parts = {_local(child.tag): child for child in cell}
    if kind == "inlineStr":
        return _joined(parts["is"]) if "is" in parts else None
    text = parts["v"].text if "v" in parts else None
    if text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return "true" if text.strip() == "1" else "false"
    if kind == "n":
        return _number(text, shift, int(cell.get("s", 0)) in dates, header)
    return _plain(text)


def workbook_rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows (path, row, first, cells) of a sheet of each workbook in a table of (path, content).

    ``first`` marks the header. Null content has no rows; other columns are not read.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(path, found, start):
            numbers, cells = [n for n, _ in found], [c for _, c in found]
            arrays = [pa.array([path] * len(found), pa.string()), pa.array(numbers, pa.int64())]
            arrays += [pa.array([start and i == 0 for i in range(len(found))]), pa.array(cells, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "row", "first", "cells"])

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                if not content.is_valid:
                    continue
                found, held, start = [], 0, True
                for number, cells in sheet_rows(content.as_py(), sheet):
                    found.append((number, cells))
                    held += len(cells) + 1
                    if held >= BATCH_CELLS:
                        yield batch_of(path.as_py(), found, start)
                        found, held, start = [], 0, False
                if found:
                    yield batch_of(path.as_py(), found, start)

    return files.select("path", "content").mapInArrow(parse, "path string, row long, first boolean, cells array<string>")


def sheet_table(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """A sheet as a table of texts with the header's names; all workbooks must have one header.

    Columns without a name are left out, and rows without any value too. Only headers come to the
    driver, two at most.
    """
    # The files are parsed once: the header and the rows are read from what is written here.
    rows = materialised(workbook_rows(files, sheet), "workbook")
    headers = rows.where("first").select("cells").distinct().limit(2).collect()
    if not headers:
        raise ValueError("no workbook with a header")
    if len(headers) > 1:
        raise ValueError("the workbooks have different headers")
    names = [(i, name) for i, name in enumerate(headers[0].cells) if name is not None and name.strip()]
    if len({name.lower() for _, name in names}) < len(names):
        raise ValueError("two columns have the same name")
    filled = rows.where(~F.col("first") & F.exists("cells", lambda c: c.isNotNull()))
    return filled.select(*(F.get("cells", F.lit(i)).alias(name) for i, name in names))


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Scan a sheet (the first if none is named) of all workbooks at a path that Spark can read."""
    return sheet_table(spark.read.format("binaryFile").load(path), sheet)


def _safe(text: str) -> str:
    return escape(UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _written(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return f'<c s="1"><v>{(value - ORIGIN.date()).days}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_safe(str(value))}</t></is></c>'


def _book(header: list[str], rows: Iterator[tuple], name: str) -> bytes:
    """Content of a workbook with one sheet; names of digits alone become numbers."""
    out = io.BytesIO()
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(
            f'<Override PartName="/xl/{part}.xml" ContentType="{kind}.{of}+xml"/>'
            for part, of in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles"))
        )
        rels = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        book.writestr("[Content_Types].xml", f'<Types xmlns="{CONTENT}">{rels}{parts}</Types>')
        link = '<Relationship Id="r{}" Type="' + RELATIONS + '/{}" Target="{}"/>'
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}">{link.format(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
        links = link.format(1, "worksheet", "worksheets/sheet1.xml") + link.format(2, "styles", "styles.xml")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        sheets = f'<sheets><sheet name={quoteattr(name)} sheetId="1" r:id="r1"/></sheets>'
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}">{sheets}</workbook>')
        fill = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        styles = '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs>'
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{fill}{styles}</styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            names = "".join(_written(int(n) if n.isascii() and n.isdigit() else n) for n in header)
            part.write(f"<row>{names}</row>".encode())
            for row in rows:
                part.write(f"<row>{''.join(map(_written, row))}</row>".encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def pack(df: DataFrame, rows_per_file: int = 10_000, name: str = "Sheet1") -> DataFrame:
    """Workbooks (path, content) of at most ``rows_per_file`` rows, made where the rows lie."""
    if not 0 < rows_per_file < MOST_ROWS:
        raise ValueError(f"a workbook holds 1 to {MOST_ROWS - 1} rows")
    header = df.columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []

        def book(rows):
            content = pa.array([_book(header, iter(rows), name)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{made:05d}.xlsx"]), content], names=["path", "content"])

        for batch in batches:
            held.extend(zip(*(column.to_pylist() for column in batch.columns)))
            while len(held) >= rows_per_file:
                yield book(held[:rows_per_file])
                held, made = held[rows_per_file:], made + 1
        if held:
            yield book(held)

    return df.mapInArrow(build, "path string, content binary")

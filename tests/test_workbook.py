"""Workbooks: hand-made files, as other programs write them, and round trips."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import day, rows
from wearlog.sources import wide, workbook

BOOK = f'<workbook xmlns="{workbook.MAIN}" xmlns:r="{workbook.RELATIONS}">{{}}<sheets><sheet name="Notes" sheetId="1" r:id="a"/><sheet name="Log" sheetId="2" r:id="b"/></sheets></workbook>'
RELS = f'<Relationships xmlns="{workbook.PACKAGE}"><Relationship Id="a" Type="t" Target="worksheets/s1.xml"/><Relationship Id="b" Type="t" Target="/xl/worksheets/s2.xml"/></Relationships>'
STYLES = f'<styleSheet xmlns="{workbook.MAIN}"><numFmts count="2"><numFmt numFmtId="164" formatCode="dd\\.mm\\.yyyy"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
SHARED = f'<sst xmlns="{workbook.MAIN}"><si><t>Category</t></si><si><t>Item</t></si><si><r><t>Blue_x000D_\n</t></r><r><t>top</t></r><rPh><t>no</t></rPh></si><si><t>x</t></si></sst>'
LOG = """<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>Price</t></is></c>
<c r="D2" t="str"><v>Date purchased</v></c><c r="F2" s="1"><v>{0}</v></c><c r="G2"><v>{1}.0</v></c></row>
<row r="3"><c r="A3" t="inlineStr"><is><t>Shirts</t></is></c><c r="B3" t="s"><v>2</v></c><c r="C3" s="2"><v>10.5</v></c><c r="D3" s="1"><v>{0}</v></c><c r="F3" t="s"><v>3</v></c></row>
<row r="5"/><row r="9"><c t="str"><v>Pants</v></c><c t="str"><v>Jeans</v></c><c t="e"><v>#N/A</v></c><c/><c/><c/><c t="b"><v>1</v></c></row>"""


def write(path, first=43831, system=""):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", BOOK.format(system))
        book.writestr("xl/_rels/workbook.xml.rels", RELS)
        book.writestr("xl/styles.xml", STYLES)
        book.writestr("xl/sharedStrings.xml", SHARED)
        for name, content in (("s1", ""), ("s2", LOG.format(first, first + 1))):
            book.writestr(f"xl/worksheets/{name}.xml", f'<worksheet xmlns="{workbook.MAIN}"><sheetData>{content}</sheetData></worksheet>')


@pytest.mark.parametrize("first,system", [(43831, ""), (43831 - 1462, '<workbookPr date1904="1"/>')])
def test_sheet_of_another_program(spark, tmp_path, first, system):
    write(tmp_path / "log.xlsx", first, system)
    sheet = workbook.read_workbook(spark, str(tmp_path), "Log")
    if not system:
        assert sheet.columns == ["Category", "Item", "Price", "Date purchased", "43831", "43832"]
        clean = wide.clean_sheet(sheet, header="serial")
        assert rows(clean, "item", "price", "date_purchased") == [("Blue top", 10.5, day(1)), ("Jeans", None, None)]
        assert rows(wide.to_log(clean), "item", "date", "used") == [
            ("Blue top", day(1), True), ("Blue top", day(2), False), ("Jeans", day(1), False), ("Jeans", day(2), True),
        ]
    else:
        assert sheet.columns[4] == "43831"
        assert [r["Date purchased"] for r in sheet.collect()] == ["2020-01-01", None]


def test_missing_sheets_and_headers(spark, tmp_path):
    write(tmp_path / "log.xlsx")
    for sheet in ("Nothing", None):
        with pytest.raises(Exception, match="no sheet|no workbook"):
            workbook.read_workbook(spark, str(tmp_path / "log.xlsx"), sheet)
    write(tmp_path / "later.xlsx", 43900)
    with pytest.raises(ValueError, match="different headers"):
        workbook.read_workbook(spark, str(tmp_path), "Log")


def test_files_of_one_diary(spark, tmp_path):
    """A table packed into several real files reads back as the CSV does, by way of ``read_wide``."""
    table = spark.createDataFrame(
        [("Shirts", f"top {i}\r\n<&> _x0041_", 1.5 * i, dt.date(2020, 1, 1), "x" if i % 2 else None, None if i % 3 else "x") for i in range(25)],
        "Category string, Item string, Price double, `Date purchased` date, `43831` string, `43832` string",
    )
    books = workbook.pack(table.repartition(2), rows_per_file=5).collect()
    assert len(books) >= 5 and len({b.path for b in books}) == len(books)
    for b in books:
        (tmp_path / b.path).write_bytes(b.content)
    got, expected = wide.read_wide(spark, str(tmp_path), "serial", "xlsx"), wide.clean_sheet(table, "serial")
    assert got.schema.simpleString() == expected.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    log = wide.read_log(spark, str(tmp_path), "serial", "xlsx", first=day(2))
    assert sorted(map(tuple, log.collect())) == sorted(map(tuple, wide.to_log(expected, first=day(2)).collect()))


TEXT = st.text(st.characters(exclude_categories=("Cs",)), max_size=12) | st.sampled_from(["_x0041_", "_x005F_x0041_", "\r\n", " a ", "\x01"])
VALUE = st.none() | TEXT | st.booleans() | st.integers(-(2**52), 2**52) | st.floats(allow_nan=False, allow_infinity=False) | st.dates(dt.date(1900, 3, 1))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(VALUE, min_size=3, max_size=3), max_size=5))
def test_cells_round_trip(values):
    def text(v):
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() and abs(v) < 2**53 else repr(v)
        return None if v is None else v.isoformat() if isinstance(v, dt.date) else str(v)

    found = list(workbook.sheet_rows(workbook._book(["a", "7", "c"], iter(map(tuple, values)), 'A & "B"'), 'A & "B"'))
    padded = [cells + [None] * (3 - len(cells)) for _, cells in found]
    assert padded == [["a", "7", "c"], *([text(v) for v in row] for row in values)]
    assert [n for n, _ in found] == list(range(1, len(values) + 2))

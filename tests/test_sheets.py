import datetime
import zipfile
from xml.sax.saxutils import escape

import pytest

from termloom.sources import readers, sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letter(i):
    return (letter(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def write(path, rows, inline=False, date1904=False):
    """A workbook with one sheet: texts shared or inline, booleans, numbers, dates by style 1, errors as Exception."""
    strings, body = [], []
    for n, row in enumerate(rows, 1):
        cells = []
        for i, v in enumerate(row):
            at = f'r="{letter(i)}{n}"'
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c {at} t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, datetime.datetime):
                days = (v - sheets.ZERO_DAYS[date1904]) / datetime.timedelta(days=1)
                cells.append(f'<c {at} s="1"><v>{days!r}</v></c>')
            elif isinstance(v, Exception):
                cells.append(f'<c {at} t="e"><v>#N/A</v></c>')
            elif isinstance(v, str) and inline:
                cells.append(f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            elif isinstance(v, str):
                strings.append(v)
                cells.append(f'<c {at} t="s"><v>{len(strings) - 1}</v></c>')
            else:
                cells.append(f"<c {at}><v>{v!r}</v></c>")
        if cells:
            body.append(f'<row r="{n}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="x" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/own.xml"/></Relationships>')
        z.writestr("xl/worksheets/own.xml", f"<worksheet {NS}><sheetData>{''.join(body)}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><r><t>{escape(s[:1])}</t></r><r><t xml:space="preserve">{escape(s[1:])}</t></r></si>' for s in strings)}</sst>")


DAY = datetime.datetime(2024, 2, 3, 10, 30)
ROWS = [[" nome ", "n", "x", "ok", "data", None, "vazio"], ["Zé & <b>", 1, 1.5, True, DAY, "a"], [None] * 6, ["B\x09c", 2, -2, False, datetime.datetime(1999, 12, 31), None], ["NA", None, 1e20, None, None, ValueError()]]


@pytest.mark.parametrize("inline,date1904", [(False, False), (True, True)])
def test_sheet(spark, tmp_path, inline, date1904):
    write(tmp_path / "t.xlsx", ROWS, inline, date1904)
    df = readers.load(spark, str(tmp_path / "t.xlsx"))
    assert dict(df.dtypes) == {"nome": "string", "n": "bigint", "x": "double", "ok": "boolean", "data": "timestamp_ntz", "Unnamed: 5": "string"}
    assert [tuple(r) for r in df.collect()] == [("Zé & <b>", 1, 1.5, True, DAY, "a"), ("Bc", 2, -2.0, False, datetime.datetime(1999, 12, 31), None), (None, None, 1e20, None, None, None)]


def test_folder_of_sheets(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for f in range(3):
        write(tmp_path / "many" / f"f{f}.xlsx", [["a", "a", "data"], *[[f * 1000 + i, f"t{i}", "02/03/2024" if i % 2 == 0 else "13/01/2024"] for i in range(1500)]])
    (tmp_path / "many" / "notes.txt").write_text("no sheet")
    df = readers.read_excel(spark, str(tmp_path / "many"))
    assert df.columns == ["a", "a.1", "data"] and df.count() == 4500
    assert {r[0] for r in df.select("data").distinct().collect()} == {None, datetime.datetime(2024, 2, 3)}  # the first value's format
    assert df.selectExpr("sum(a)").first()[0] == sum(f * 1000 + i for f in range(3) for i in range(1500))


def test_empty_and_old(spark, tmp_path):
    write(tmp_path / "e.xlsx", [])
    assert readers.read_excel(spark, str(tmp_path / "e.xlsx")).columns == []
    write(tmp_path / "h.xlsx", [["a", "b"]])
    assert readers.read_excel(spark, str(tmp_path / "h.xlsx")).count() == 0
    with pytest.raises(ValueError, match="xls"):
        readers.load(spark, "x.xls")


@pytest.mark.parametrize("code,yes", [("dd/mm/yyyy", True), ("h:mm", True), ("0.00", False), ("#,##0", False), ('"day" 0', False), ("[Red]0", False), ("General", False), ("yyyy\\-mm", True)])
def test_date_formats(code, yes):
    assert sheets.is_date(code) is yes


def test_columns():
    assert [sheets.column_number(x) for x in ("A1", "Z9", "AA10", "AZ1", "BA1")] == [0, 25, 26, 51, 52]
    assert sheets.named(["a", None, "a", "", "a"]) == ["a", "Unnamed: 1", "a.1", "Unnamed: 3", "a.2"]

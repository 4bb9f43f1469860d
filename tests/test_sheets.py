"""Spreadsheet cells: display text, dense rows, guards, and workbooks themselves."""

import tracemalloc
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bytelayout.functions.render import general_text, number_text, serial_date, typed_text
from bytelayout.sources import xlsx
from bytelayout.sources.cells import CELLS_SCHEMA, column_letters, sheet_rows
from bytelayout.sources.xlsx import read_xlsx

CONTENT = """<?xml version="1.0" encoding="UTF-8"?>"""
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_xlsx(path, sheet_data, formats=(), shared=(), sheet_name="資料", from_1904=False):
    """A minimal workbook; style n uses formats[n - 1], style 0 is General."""
    custom = "".join(
        f'<numFmt numFmtId="{164 + n}" formatCode="{code}"/>'
        for n, code in enumerate(formats) if isinstance(code, str)
    )
    styles = '<xf numFmtId="0"/>' + "".join(
        f'<xf numFmtId="{164 + n if isinstance(code, str) else code}"/>' for n, code in enumerate(formats)
    )
    strings = "".join(f"<si>{text}</si>" for text in shared)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'{CONTENT}<workbook xmlns="{MAIN}" xmlns:r="{RELATION}">{'<workbookPr date1904="1"/>' if from_1904 else ""}<sheets>'
            f'<sheet name="{sheet_name}" sheetId="2" r:id="rId7"/><sheet name="b" sheetId="1" r:id="rId1"/>'
            "</sheets></workbook>",
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'{CONTENT}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId7" Target="worksheets/sheet9.xml"/></Relationships>',
        )
        book.writestr(
            "xl/styles.xml",
            f'{CONTENT}<styleSheet xmlns="{MAIN}"><numFmts>{custom}</numFmts>'
            f"<cellXfs>{styles}</cellXfs></styleSheet>",
        )
        book.writestr("xl/sharedStrings.xml", f'{CONTENT}<sst xmlns="{MAIN}">{strings}</sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        book.writestr(
            "xl/worksheets/sheet9.xml",
            f'{CONTENT}<worksheet xmlns="{MAIN}"><sheetData>{sheet_data}</sheetData></worksheet>',
        )


def test_workbooks(spark, tmp_path):
    write_xlsx(
        tmp_path / "shown.xlsx",
        '<row r="2"><c r="B2" s="2"><v>38353</v></c><c r="C2" s="1"><v>0.0725</v></c><c r="D2" t="s"><v>1</v></c>'
        '<c r="E2" t="b"><v>0</v></c><c r="F2" s="4"><v>38353.5</v></c><c r="G2" s="3"><f>7/2</f><v>3.5</v></c><c r="H2" s="4"/></row>'
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="R3" t="str"><v>far right</v></c>'
        '<c r="B3" t="inlineStr"><is><t>in line</t></is></c></row>',
        formats=("0.00%", "yyyy-mm-dd", "0.00", 14),
        shared=("<t>0070 01</t>", "<r><t>臺</t></r><r><t>灣</t></r><rPh><t>x</t></rPh>"),
    )
    write_xlsx(tmp_path / "formula.xlsx", '<row r="3"><c r="C3"><f>SUM(A1:A2)</f></c></row>')
    write_xlsx(tmp_path / "odd.xlsx", '<row r="1"><c r="AB1" s="1"><v>1</v></c></row>', formats=("[h]:mm",))
    write_xlsx(tmp_path / "nan.xlsx", '<row r="1"><c r="B1"><v>12a</v></c></row>')
    write_xlsx(tmp_path / "empty.xlsx", "")
    write_xlsx(tmp_path / "far.xlsx", '<row r="100001"><c r="A100001"><v>1</v></c></row>')
    (tmp_path / "broken.xlsx").write_bytes(b"PK not a zip")
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    source = read_xlsx(spark, str(tmp_path), 9)
    rows = source.rows.orderBy("source_row").collect()
    assert {row.file_id.rsplit("/", 1)[1] for row in rows} == {"shown.xlsx"}
    assert rows[0].fields == [""] * 9
    assert rows[1].fields == ["", "2005-01-01", "7.25%", "臺灣", "FALSE", "2005/01/01", "3.50", "", ""]
    assert len(rows[2].fields) == 18
    assert (rows[2].fields[0], rows[2].fields[1], rows[2].fields[16:]) == ("0070 01", "in line", ["", "far right"])
    issues = {row.file_id.rsplit("/", 1)[1]: row.message for row in source.issues.collect()}
    assert issues["formula.xlsx"].endswith("Cell C3: the formula has no saved result.")
    assert issues["nan.xlsx"].endswith("Cell B1: the value is not a number.")
    assert "Cell AB1" in issues["odd.xlsx"]
    assert set(issues) == {"formula.xlsx", "odd.xlsx", "nan.xlsx", "empty.xlsx", "far.xlsx", "broken.xlsx", "old.xls"}


def test_dates_counted_from_1904(spark, tmp_path):
    cells = '<row r="1"><c r="A1" s="1"><v>36891</v></c><c r="B1"><v>36891</v></c></row>'
    write_xlsx(tmp_path / "mac.xlsx", cells, formats=("yyyy-mm-dd",), from_1904=True)
    assert read_xlsx(spark, str(tmp_path), 2).rows.first().fields == ["2005-01-01", "36891"]


def sheet_xml(rows, columns=2):
    return "".join(
        f'<row r="{r}">' + "".join(f'<c r="{"ABCDEFGH"[c]}{r}"><v>{r * 10 + c}</v></c>' for c in range(columns)) + "</row>"
        for r in range(1, rows + 1)
    )


def test_large_sheets_come_in_bounded_frames(spark, tmp_path):
    write_xlsx(tmp_path / "long.xlsx", sheet_xml(60_000))
    content = (tmp_path / "long.xlsx").read_bytes()
    books = pd.DataFrame({"file_id": ["long"], "content": [content]})
    frames = [len(frame) for frame in xlsx._extract(iter([books]))]
    assert frames == [50_000, 50_000, 20_000]
    tracemalloc.start()
    assert sum(1 for _ in xlsx.workbook_cells(content)) == 120_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # the tree of the rows alone would take over 50 MB
    rows = read_xlsx(spark, str(tmp_path), 2).rows
    assert rows.count() == 60_000 and rows.filter("source_row = 59999").first().fields == ["599990", "599991"]


def test_reading_ends_beyond_the_supported_extent(spark, tmp_path):
    write_xlsx(tmp_path / "far.xlsx", sheet_xml(50) + "<row><c r='damage")
    content = (tmp_path / "far.xlsx").read_bytes()
    assert sum(1 for _ in xlsx.workbook_cells(content, max_rows=20)) == 41  # damage further on is not reached
    source = read_xlsx(spark, str(tmp_path), 2, max_rows=20)
    assert source.rows.isEmpty() and [r.message for r in source.issues.collect()] == [
        "Malformed spreadsheet. the sheet reaches beyond the supported rows or columns."
    ]
    wide = read_xlsx(spark, str(tmp_path), 2, max_columns=1)
    assert wide.rows.isEmpty() and wide.issues.count() == 1


def test_damage_met_late_leaves_no_rows(spark, tmp_path):
    write_xlsx(tmp_path / "late.xlsx", sheet_xml(30_000) + "<row><c r='damage")
    write_xlsx(tmp_path / "good.xlsx", sheet_xml(3))
    source = read_xlsx(spark, str(tmp_path), 2)
    assert {row.file_id.rsplit("/", 1)[1] for row in source.rows.collect()} == {"good.xlsx"}
    assert [row.message for row in source.issues.collect()] == ["Malformed spreadsheet. the workbook cannot be read."]


def test_a_cell_given_twice(spark):
    cells = cells_of(spark, [(0, c, "s", v, None, None, None) for c, v in ((0, "1"), (0, "1"), (2, "2"))])
    assert sheet_rows(cells, 2).rows.first().fields == ["1", "", "2"]


def cells_of(spark, cells):
    return spark.createDataFrame(
        [("f", 0, "s", r, c, kind, v, w, f, z) for r, c, kind, v, w, f, z in cells], CELLS_SCHEMA
    )


def test_leading_blank_rows_and_gaps(spark):
    cells = cells_of(spark, [
        (2, 1, "s", "b", None, None, None), (4, 0, "n", "1", "one", None, "0"), (4, 1, "s", "", None, None, None),
    ])
    rows = sheet_rows(cells, 2).rows.orderBy("source_row").collect()
    assert [row.fields for row in rows] == [["", ""], ["", ""], ["", "b"], ["", ""], ["one", ""]]
    assert sheet_rows(cells, 3).rows.filter("size(fields) <> 3").isEmpty()
    guarded = sheet_rows(cells, 2, max_rows=4)
    assert guarded.rows.isEmpty() and guarded.issues.count() == 1


def test_column_letters(spark):
    df = spark.createDataFrame([(n,) for n in (0, 25, 26, 701, 702, 1023, 16383)], "c int")
    got = [row.a for row in df.select(column_letters(F.col("c")).alias("a")).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA", "AMJ", "XFD"]


def test_general_numbers(spark):
    cases = [
        (0.0, "0"), (45292.0, "45292"), (0.125, "0.125"), (-1.5, "-1.5"), (0.1 + 0.2, "0.3"),
        (1 / 3, "0.333333333"), (123456789.1, "123456789.1"), (12345678901.0, "12345678901"),
        (123456789012.0, "1.23457E+11"), (1e21, "1E+21"), (0.0001, "0.0001"), (99999.5, "99999.5"),
    ]
    df = spark.createDataFrame(cases, "n double, t string")
    assert [row.g for row in df.select(general_text(F.col("n")).alias("g")).collect()] == [t for _, t in cases]


def test_dates_and_typed_columns(spark):
    df = spark.sql(
        "select 1d as one, 60d as sixty, 61d as next, 45292.75d as d, timestamp'2024-02-03 04:05:06' as t,"
        " true as b, cast(null as string) as s, 7 as i"
    )
    row = df.select(
        serial_date(F.col("one")).cast("string").alias("a"), serial_date(F.col("next")).cast("string").alias("b"),
        number_text(F.col("d"), "yyyymmdd").alias("c"), typed_text(F.col("t"), "timestamp", "yyyymmdd").alias("d"),
        typed_text(F.col("b"), "boolean", None).alias("e"), typed_text(F.col("i"), "int", None).alias("f"),
        number_text(F.col("d"), "0.00").alias("g"),
    ).first()
    assert list(row) == ["1900-01-01", "1900-03-01", "20240101", "20240203", "TRUE", "7", "45292.75"]
    with pytest.raises(TypeError):
        typed_text(F.col("d"), "double", None)
    with pytest.raises(ValueError):
        number_text(F.col("d"), "[h]:mm")

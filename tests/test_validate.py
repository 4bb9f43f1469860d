"""Row and field rules against hand-made truth tables and made rows."""

import pytest
from pyspark.sql import functions as F

from bytelayout.functions.charset import BIG5, CP950, decode_big5, encode_big5
from bytelayout.layout import FieldSpec, Layout
from bytelayout.operators.reports import (
    cap_issues, gate, in_report_order, issue_counts, issue_table, preview, records, summarize,
)
from bytelayout.operators.validate import validate, with_field_results
from bytelayout.session import CHARSET_FLAGS, charset_flags

def rows_of(spark, data, file_id="f"):
    return spark.createDataFrame(
        [(file_id, number, list(fields)) for number, fields in enumerate(data, start=1)],
        "file_id string, source_row bigint, fields array<string>",
    )


def codes(spark, value, width=20, required=False, default="", filler="x"):
    """Codes of the first field; the second keeps the record from being blank."""
    layout = Layout((FieldSpec(width, required, default), FieldSpec(1)))
    checked = validate(rows_of(spark, [[value, filler]]), layout)
    row = checked.select("issues", "valid").first()
    return [issue["code"] for issue in row["issues"]], row["valid"]


@pytest.mark.parametrize(
    "value, expected, valid",
    [
        ("00123", [], True),
        ("", [], True),
        ("a b", [], True),
        (" a", ["LEADING_WHITESPACE"], True),
        ("a ", ["TRAILING_WHITESPACE"], True),
        (" ", ["LEADING_WHITESPACE", "TRAILING_WHITESPACE", "WHITESPACE_ONLY_FIELD"], True),
        ("　a", ["LEADING_WHITESPACE", "NON_ASCII_WHITESPACE"], True),
        ("中　文", ["NON_ASCII_WHITESPACE"], True),
        ("a b", ["NON_ASCII_WHITESPACE", "UNENCODABLE_BIG5"], False),
        ("a﻿b", ["NON_ASCII_WHITESPACE", "UNENCODABLE_BIG5"], False),
        ("a\u0085", ["UNSUPPORTED_CONTROL_CHARACTER"], False),
        ("a​b", ["UNENCODABLE_BIG5"], False),
        ("a\tb", ["NON_ASCII_WHITESPACE", "UNSUPPORTED_CONTROL_CHARACTER"], False),
        ("a\n", ["TRAILING_WHITESPACE", "NON_ASCII_WHITESPACE", "UNSUPPORTED_CONTROL_CHARACTER"], False),
        ("a\x7f", ["UNSUPPORTED_CONTROL_CHARACTER"], False),
        ("\x1c", ["UNSUPPORTED_CONTROL_CHARACTER"], False),
        ("😀", ["UNENCODABLE_BIG5"], False),
        ("", ["UNENCODABLE_BIG5"], False),
        ("€～碁裏", [], True),
        ("a?b", [], True),
        ("測" * 10, [], True),
        ("測" * 10 + "a", ["WIDTH_OVERFLOW"], False),
        ("x" * 21, ["WIDTH_OVERFLOW"], False),
    ],
)
def test_field_rules(spark, value, expected, valid):
    assert codes(spark, value) == (expected, valid)


def test_required_and_default(spark):
    assert codes(spark, "", required=True) == (["MISSING_REQUIRED"], False)
    spaces = ["LEADING_WHITESPACE", "TRAILING_WHITESPACE", "WHITESPACE_ONLY_FIELD"]
    assert codes(spark, "  ", required=True) == ([*spaces, "MISSING_REQUIRED"], False)
    assert codes(spark, " ", default="d") == (spaces, True)
    assert codes(spark, "", default="超過二十個位元組的預設值") == (["WIDTH_OVERFLOW"], False)
    assert codes(spark, "", required=True, default="d") == ([], True)
    assert codes(spark, "a\tb", width=1)[0][-1] == "UNSUPPORTED_CONTROL_CHARACTER"


def test_record_rules(spark):
    layout = Layout((FieldSpec(2, default_value="z"), FieldSpec(2)))
    data = [["", ""], [" ", "　"], ["a"], [""], [" "], ["a", "b", "c"], [], ["a", "b"]]
    checked = validate(rows_of(spark, data), layout).orderBy("source_row").collect()
    assert [[i["code"] for i in row["issues"]] for row in checked] == [
        ["EMPTY_RECORD"],
        ["WHITESPACE_ONLY_RECORD"],
        ["INVALID_COLUMN_COUNT"],
        ["EMPTY_RECORD", "INVALID_COLUMN_COUNT"],
        ["WHITESPACE_ONLY_RECORD", "INVALID_COLUMN_COUNT"],
        ["INVALID_COLUMN_COUNT"],
        ["EMPTY_RECORD", "INVALID_COLUMN_COUNT"],
        [],
    ]
    assert [row["valid"] for row in checked] == [False] * 7 + [True]


def test_field_results(spark):
    layout = Layout((FieldSpec(4, default_value="預"), FieldSpec(2), FieldSpec(3, required=True)))
    data = [["", "abc", " "], ["中", "\t", "a"], ["中", "😀", "a"]]
    checked = with_field_results(validate(rows_of(spark, data), layout), layout)
    found = [
        [(f.used_default, f.value_bytes, f.padding_bytes) for f in row.field_results]
        for row in checked.orderBy("source_row").collect()
    ]
    assert found == [
        [(True, 2, 2), (False, 3, 0), (False, 0, 0)],
        [(False, 2, 2), (False, 0, 0), (False, 1, 2)],
        [(False, 2, 2), (False, 0, 0), (False, 1, 2)],
    ]


def made_rows(count):
    """Fields of the built-in layout in several scripts and lengths, now and then filled to the byte."""
    rows = []
    for n in range(1, count + 1):
        row = []
        for at, width in enumerate(Layout.built_in().widths):
            size = width if n % 7 == at % 7 else 1 + (n * (at + 3)) % width
            row.append("中文字測試"[n % 5] * (size // 2) + "z" * (size % 2) if at % 3 == 1 else str(n * 31)[:size] or "0")
        rows.append(row)
    return rows


@pytest.mark.parametrize("alignment", ["left", "right"])
def test_bytes_of_valid_rows(spark, alignment):
    data = made_rows(200)
    layout = Layout.built_in().with_options(alignment=alignment)
    checked = validate(rows_of(spark, data), layout)
    summary = summarize(checked, layout)
    assert summary.first().asDict() == {
        "file_id": "f", "actual_rows": 200, "valid_rows": 200, "invalid_rows": 0,
        "error_count": 0, "warning_count": 0, "record_width_bytes": 208, "output_size": 42000,
    }
    written = records(gate(checked, summary), layout).orderBy("source_row").collect()
    pad = bytes.ljust if alignment == "left" else bytes.rjust
    expected = b"".join(
        b"".join(pad(value.encode("big5"), width) for value, width in zip(row, layout.widths)) + b"\r\n" for row in data
    )
    assert b"".join(bytes(row["record"]) for row in written) == expected


def test_issues_of_faults_by_position(spark):
    data = made_rows(5)
    faults = {0: (0, "QQ"), 1: (4, "七個中文字呀"), 2: (8, "長" * 61), 3: (8, "路😀口"), 4: (9, "N" * 16)}
    for row, (at, value) in faults.items():
        data[row][at] = value
    layout = Layout.built_in().with_options(expected_rows=5)
    checked = validate(rows_of(spark, data), layout)
    issues = in_report_order(issue_table(checked, layout)).collect()
    assert [(i.source_row, i.field_index, i.code, i.actual, i.allowed) for i in issues] == [
        (1, 1, "WIDTH_OVERFLOW", 2, 1),
        (2, 5, "WIDTH_OVERFLOW", 12, 10),
        (3, 9, "WIDTH_OVERFLOW", 122, 120),
        (4, 9, "UNENCODABLE_BIG5", None, None),
        (5, 10, "WIDTH_OVERFLOW", 16, 15),
    ]
    assert issues[0].message == "Row 1, field 1 needs 2 bytes, the width is 1."
    summary = summarize(checked, layout)
    assert summary.first()["output_size"] is None
    assert gate(checked, summary).count() == 0


def test_counts_gate_and_cap(spark):
    layout = Layout.of_widths([1, 1], expected_rows=2)
    data = rows_of(spark, [["a", "b"], ["c", "d"]], "good").unionByName(
        rows_of(spark, [["a", "b"]], "short")
    ).unionByName(rows_of(spark, [["aa", "bb"], [" ", "x"]], "bad"))
    files = spark.createDataFrame([("good",), ("short",), ("bad",), ("none",)], "file_id string")
    checked = validate(data, layout)
    summary = summarize(checked, layout, files)
    by_file = {row.file_id: row for row in summary.collect()}
    assert {name: (row.error_count, row.warning_count, row.output_size) for name, row in by_file.items()} == {
        "good": (0, 0, 8), "short": (1, 0, None), "bad": (2, 3, None), "none": (1, 0, None),
    }
    assert {row.file_id for row in gate(checked, summary).collect()} == {"good"}
    issues = issue_table(checked, layout, files)
    counted = {(r.file_id, r.code): r.issue_count for r in issue_counts(issues).collect()}
    assert counted[("none", "INVALID_RECORD_COUNT")] == 1
    assert counted[("bad", "WIDTH_OVERFLOW")] == 2
    shown = cap_issues(issues, 2).filter("file_id = 'bad'").orderBy("rank").collect()
    assert [(row.field_index, row.hidden_count) for row in shown] == [(1, 3), (2, 3)]


def test_preview_marks_and_padding(spark):
    layout = Layout.of_widths([6, 3])
    checked = validate(rows_of(spark, [["a b　", "x"], ["toolong!", "x"], ["中", ""]]), layout)
    assert [r.preview for r in preview(checked, layout, 5).orderBy("source_row").collect()] == [
        "a·b□·x··", "中·······"
    ]
    assert preview(checked, layout, 1).count() == 1
    assert preview(checked, layout, None).count() == 2
    right = layout.with_options(alignment="right")
    assert preview(checked, right, 1).first().preview == "·a·b□··x"


def test_charset(spark):
    chars = [chr(c) for c in range(0xA0, 0x2FFFF) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    with charset_flags(spark):
        df = df.select("c", encode_big5(F.col("c")).alias("b"), encode_big5(F.col("c"), CP950).alias("w"))
        df = df.select("c", "b", "w", decode_big5(F.col("b")).alias("d"))
    rows = df.filter("b is not null or w is not null").collect()
    own = {row.c: bytes(row.b) for row in rows if row.b is not None}
    assert all(row.d == row.c for row in rows if row.b is not None)
    assert not any(0xE000 <= ord(c) <= 0xF8FF for c in own)
    assert len(own) == 18585 - 128
    # The standard library's HKSCS table agrees but for these two and a few symbols.
    other = {}
    for c in chars:
        try:
            other[c] = c.encode("big5hkscs")
        except UnicodeEncodeError:
            continue
    assert {c for c in own.keys() & other.keys() if own[c] != other[c]} == {"／", "＼"}
    assert own["€"] == b"\xa3\xe1" and own["═"] == b"\xf9\xf9" and own["é"] == b"\x88\x6d"
    assert sum(row.w is not None for row in rows) == 19838 - 6217 - 128


def test_charset_sequences_and_strict_decode(spark):
    values = ["Ê̄", "xê̌", "Ê", "", "̄"]
    with charset_flags(spark):
        df = spark.createDataFrame([(v,) for v in values], "v string").select(
            "v", encode_big5(F.col("v")).alias("b")
        )
        df = df.select("v", "b", decode_big5(F.col("b")).alias("d"))
        bad = spark.createDataFrame(
            [(bytearray(b),) for b in (b"\xa4", b"\x80\xff", b"\xa2\xa4", b"\xa4\xa4A", b"\xfa\x40")], "b binary"
        ).select(decode_big5(F.col("b")).alias("d"))
    got = {row.v: (row.b and bytes(row.b), row.d) for row in df.collect()}
    assert got["Ê̄"] == (b"\x88\x62", "Ê̄")
    assert got["xê̌"] == (b"x\x88\xa5", "xê̌")
    assert got["Ê"] == (b"\x88\x66", "Ê")
    assert got[""] == (None, None) and got["̄"] == (None, None)
    texts = [row.d for row in bad.collect()]
    assert texts[:4] == [None, None, None, "中A"]


def test_flags_are_restored(spark):
    before = {key: spark.conf.get(key, None) for key in CHARSET_FLAGS}
    with charset_flags(spark):
        df = spark.createDataFrame([("中",)], "v string").select(encode_big5(F.col("v"), BIG5).alias("b"))
    assert {key: spark.conf.get(key, None) for key in CHARSET_FLAGS} == before
    assert bytes(df.first().b) == b"\xa4\xa4"

"""Layouts as objects, tables and settings documents."""

import json

import pytest
from pyspark.sql import functions as F

from bytelayout.functions.text import mark_whitespace, mask_value, output_name
from bytelayout.layout import FieldSpec, InvalidSettings, Layout
from bytelayout.operators.layouts import (
    layout_diff, parse_settings, running_widths, settings_fields, settings_json,
)
from bytelayout.plans.joins import join_small
from bytelayout.sources.tables import number_rows, table_rows


def document(**changes):
    good = {
        "version": 2, "sourceEncoding": "auto", "alignment": "left", "expectedRows": 3,
        "columns": [
            {"required": True, "defaultValue": "x", "widthBytes": 4},
            {"required": False, "defaultValue": "中", "widthBytes": 2},
        ],
    }
    return json.dumps({**good, **changes}, ensure_ascii=False)


def column(**changes):
    return [{"required": False, "defaultValue": "", "widthBytes": 1, **changes}]


BAD = {
    "version": document(version=1), "version text": document(version="2"), "no version": document(version=None),
    "encoding": document(sourceEncoding="latin1"), "alignment": document(alignment="center"),
    "rows zero": document(expectedRows=0), "rows text": document(expectedRows="3"), "rows half": document(expectedRows=1.5),
    "rows bool": document(expectedRows=True), "no columns": document(columns=[]), "columns object": document(columns={}),
    "width zero": document(columns=column(widthBytes=0)), "width text": document(columns=column(widthBytes="1")),
    "required text": document(columns=column(required="true")), "default number": document(columns=column(defaultValue=1)),
    "column null": document(columns=[None]), "list": "[]", "broken": "{", "empty": "", "text": '"x"',
}
GOOD = {"plain": document(), "whole float": document(expectedRows=3.0), "extra": document(note=1)}


def test_settings_checks_agree(spark):
    for text in BAD.values():
        with pytest.raises(InvalidSettings):
            Layout.from_json(text)
    for text in GOOD.values():
        layout = Layout.from_json(text)
        assert layout.fields == (FieldSpec(4, True, ""), FieldSpec(2, False, "中"))
        assert Layout.from_json(layout.to_json()) == layout
    df = spark.createDataFrame(list({**BAD, **GOOD}.items()), "layout_id string, settings string")
    parsed = parse_settings(df).cache()
    assert {r.layout_id for r in parsed.filter("settings_ok").collect()} == set(GOOD)
    rows = settings_fields(parsed).filter("layout_id = 'plain'").orderBy("field_index").collect()
    assert [tuple(row)[1:] for row in rows] == [(1, True, "", 4), (2, False, "中", 2)]
    again = settings_json(settings_fields(parsed), expected_rows=3)
    assert parse_settings(again).filter("settings_ok").count() == len(GOOD)
    parsed.unpersist()


def test_built_in_positions(spark):
    layout = Layout.built_in()
    rows = running_widths(layout.to_dataframe(spark)).orderBy("field_index").collect()
    assert [row.end_byte for row in rows] == [1, 3, 4, 14, 24, 32, 44, 45, 165, 180, 190, 191, 199, 207, 208]
    assert [row.start_byte for row in rows] == list(layout.starts)
    assert {row.record_width_bytes for row in rows} == {208} and layout.record_width == 208
    broken = layout.to_dataframe(spark).withColumn("width_bytes", F.expr("if(field_index = 3, 0, width_bytes)"))
    ends = [row.end_byte for row in running_widths(broken).orderBy("field_index").collect()]
    assert ends[:3] == [1, 3, None] and set(ends[2:]) == {None}


def test_layout_diff(spark):
    one = Layout.built_in()
    other = Layout((FieldSpec(9), *one.fields[1:4], FieldSpec(10, True), *one.fields[5:], FieldSpec(1)))
    rows = layout_diff(other.to_dataframe(spark), one.to_dataframe(spark)).orderBy("field_index").collect()
    assert [(row.field_index, row.differs) for row in rows] == [
        (1, ["width_bytes"]), (5, ["required"]), (16, ["presence"]),
    ]
    assert layout_diff(one.to_dataframe(spark), one.to_dataframe(spark)).isEmpty()


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a b\t\r\n\r\n中　 ", "Data.CSV"), ("", "x.xlsx.xls"), ("Ab-1", "y.txt")], "v string, n string")
    rows = df.select(
        mark_whitespace(F.col("v")).alias("m"), output_name(F.col("n")).alias("o"), mask_value(F.col("v")).alias("k")
    ).collect()
    assert [row.m for row in rows] == ["a·b→↵↵中□⍽", "", "Ab-1"]
    assert [row.o for row in rows] == ["Data.txt", "x.xlsx.txt", "y.txt.txt"]
    assert rows[2].k == "xx-0" and "中" not in rows[0].k


def test_number_rows_and_table_rows(spark):
    df = spark.range(5000).selectExpr(
        "if(id % 10 < 7, 'hot', concat('f', id % 3)) as f", "(id * 7919) % 5003 as k", "cast(null as string) as s"
    )
    numbered = number_rows(df.repartition(7), "f", ["k"])
    rows = table_rows(numbered, ["k", "s"], "f", "source_row")
    expected = df.selectExpr("f", "k", "row_number() over (partition by f order by k) as n")
    wrong = rows.join(expected, (rows.file_id == expected.f) & (rows.source_row == expected.n), "left").filter(
        "k is null or fields[0] <> k or fields[1] <> ''"
    )
    assert rows.count() == 5000 and wrong.isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_small_strategies_agree(spark, how):
    big = spark.range(300).selectExpr("id", "id % 7 as k")
    small = spark.range(2, 5).selectExpr("id as k", "id * 10 as v")
    expected = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    for size in (1 << 20, -1):
        for spread in (None, F.col("id")):
            got = join_small(big, small, ["k"], how, spread_by=spread, broadcast_bytes=size)
            assert sorted(map(tuple, got.collect()), key=str) == expected

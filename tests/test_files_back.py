"""Writing fixed-width files, reading them back, comparing and profiling them."""

import csv
import hashlib
import io
import pathlib

from pyspark.sql import functions as F

from bytelayout.layout import FieldSpec, Layout
from bytelayout.operators.compare import compare_files
from bytelayout.operators.profile import (
    file_digests, profile_fields, profile_files, record_digests, file_sha256,
    unencodable_characters,
)
from bytelayout.operators.reports import issue_table, records, summarize
from bytelayout.operators.validate import validate
from bytelayout.sources.csv import read_csv
from bytelayout.sources.fixed_width import read_fixed_width, read_records
from bytelayout.sources.sink import write_csv, write_fixed_width, write_report

from test_validate import made_rows, rows_of


def joined_parts(folder):
    return b"".join(part.read_bytes() for part in sorted(pathlib.Path(folder).rglob("part-*.txt")))


def made_file(folder, data):
    stream = io.StringIO(newline="")
    csv.writer(stream).writerows(data)
    (folder / "made.utf8.csv").write_bytes(stream.getvalue().encode())
    return str(folder / "made.utf8.csv")


def test_to_bytes_and_back(spark, tmp_path):
    data, layout = made_rows(200), Layout.built_in()
    expected = b"".join(
        b"".join(value.encode("big5").ljust(width) for value, width in zip(row, layout.widths)) + b"\r\n" for row in data
    )
    source = read_csv(spark, made_file(tmp_path, data))
    checked = validate(source.rows, layout)
    out = str(tmp_path / "out")
    write_fixed_width(checked, summarize(checked, layout), layout, out, rows_per_part=37)
    folder = tmp_path / "out" / "file=made.utf8.txt"
    assert len(list(folder.rglob("part-*.txt"))) == 6
    assert joined_parts(folder) == expected
    whole = str(tmp_path / "whole")
    write_fixed_width(checked, summarize(checked, layout), layout, whole, by_block=source.by_block)
    assert joined_parts(whole) == joined_parts(folder)

    back = read_fixed_width(spark, out, layout, trim=True)
    assert back.filter("not well_sized").isEmpty()
    got = [row.fields for row in back.orderBy("record_no").collect()]
    assert got == [row.fields for row in source.rows.orderBy("source_row").collect()]
    assert {row.file_id for row in back.select("file_id").distinct().collect()} == {
        "made.utf8.txt"
    }
    exact = file_sha256(records(checked, layout), order="source_row").first()
    assert (exact["size_bytes"], exact["sha256"]) == (42000, hashlib.sha256(expected).hexdigest())


def test_nothing_is_written_for_a_file_with_errors(spark, tmp_path):
    data = made_rows(5)
    for row in data:
        row[9] = "N" * 16
    source = read_csv(spark, made_file(tmp_path, data))
    layout = Layout.built_in().with_options(expected_rows=5)
    checked = validate(source.rows, layout)
    write_fixed_width(checked, summarize(checked, layout), layout, str(tmp_path / "out"))
    assert joined_parts(tmp_path / "out") == b""
    for kind in ("csv", "parquet"):
        write_report(issue_table(checked, layout), str(tmp_path / kind), kind)
        reader = spark.read.option("header", "true").option("escape", '"').format(kind)
        assert reader.load(str(tmp_path / kind)).count() == 5


def test_csv_writing(spark, tmp_path):
    data = [["a", 'b"c', "d,e"], ["", "x\r\ny", "中"], [""], ["1", "2"]]
    write_csv(rows_of(spark, data, "t"), str(tmp_path / "out"))
    assert joined_parts(tmp_path / "out") == (
        'a,"b""c","d,e"\r\n,"x\r\ny",中\r\n\r\n1,2\r\n'.encode()
    )


def test_file_head_that_looks_like_a_mark(spark, tmp_path):
    layout = Layout.of_widths([4, 2])
    (tmp_path / "x.txt").write_bytes(b"\xef\xbb\xbf\xa4ab\r\n" + b"1234cd\r\n")
    got = read_records(spark, str(tmp_path / "x.txt"), layout).orderBy("record_no").collect()
    assert [bytes(row.record) for row in got] == [b"\xef\xbb\xbf\xa4ab", b"1234cd"]
    assert all(row.well_sized for row in got)


def records_of(spark, values, file_id="f"):
    return spark.createDataFrame(
        [(file_id, number, bytearray(value)) for number, value in enumerate(values, start=1)],
        "file_id string, record_no bigint, record binary",
    )


def test_compare(spark):
    layout = Layout.of_widths([2, 3])
    same = [b"aabbb", b"ccddd"]
    left = records_of(spark, same, "same").unionByName(records_of(spark, [b"aabbb", b"xxyyy", b"zz"], "diff"))
    left = left.unionByName(records_of(spark, [b"aabbb"], "gone"))
    right = records_of(spark, same, "same").unionByName(records_of(spark, [b"aabbb", b"xxyyz"], "diff"))
    got = {row.file_id: row for row in compare_files(left, right, layout).collect()}
    assert got["same"].equal and got["same"].first_record is None
    assert (got["diff"].first_record, got["diff"].first_field, got["diff"].different_records) == (2, 2, 2)
    assert (got["diff"].left_bytes, got["diff"].right_bytes) == (12, 10)
    assert (got["gone"].right_records, got["gone"].first_record) == (0, 1)


def test_digests(spark):
    values = [b"%05d" % n for n in range(50)]
    df = records_of(spark, values)
    one = file_digests(df.repartition(5), group=4).first()
    assert (one.record_count, one.size_bytes) == (50, 250)
    assert one.tree_sha256 == file_digests(df, group=4).first().tree_sha256
    swapped = records_of(spark, [values[1], values[0], *values[2:]])
    assert one.tree_sha256 != file_digests(swapped, group=4).first().tree_sha256
    assert record_digests(df).orderBy("record_no").first().sha256 == hashlib.sha256(values[0]).hexdigest()
    both = df.unionByName(records_of(spark, [b"x", b"", b"y" * 70000], "g"))
    exact = {row.file_id: (row.size_bytes, row.sha256) for row in file_sha256(both.repartition(3)).collect()}
    assert exact["f"] == (250, hashlib.sha256(b"".join(values)).hexdigest())
    assert exact["g"] == (70001, hashlib.sha256(b"x" + b"y" * 70000).hexdigest())


def test_one_digest_a_file_whatever_its_size(spark):
    df = records_of(spark, [b"%d" % n for n in range(100)]).unionByName(records_of(spark, [b"a", b"b"], "g"))
    many = {row.file_id: row.tree_sha256 for row in file_digests(df, group=2).collect()}
    assert set(many) == {"f", "g"} and file_digests(df, group=2).count() == 2
    assert file_digests(df.filter("file_id = 'g'"), group=2).first().tree_sha256 == many["g"]


def test_profile(spark):
    layout = Layout((FieldSpec(2), FieldSpec(3, default_value="zz")))
    checked = validate(rows_of(spark, [["a", ""], ["中文", "😀"], ["", "b"], ["x"]]), layout)
    got = {row.field_index: row for row in profile_fields(checked, layout).collect()}
    assert (got[1].empty_count, got[1].min_bytes, got[1].max_bytes, got[1].overflow_count) == (1, 0, 4, 1)
    assert (got[2].empty_count, got[2].unencodable_count, got[2].max_bytes) == (1, 1, 2)
    files = profile_files(checked).first()
    assert (files.record_count, files.min_columns, files.max_columns) == (4, 1, 2)


def test_unencodable_characters(spark):
    df = spark.createDataFrame([("f", "a😀b😀ñ"), ("f", "中é"), ("g", "ñ")], "file_id string, value string")
    got = {(r.file_id, r.character, r.code_point): r.occurrences for r in unencodable_characters(df).collect()}
    assert got == {("f", "😀", "U+1F600"): 2, ("f", "ñ", "U+00F1"): 1, ("g", "ñ", "U+00F1"): 1}

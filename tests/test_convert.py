"""Whole conversions of folders, and synthetic records."""

import contextlib

from pyspark.sql import functions as F

from bytelayout.layout import Layout
from bytelayout.operators.reports import issue_table, summarize
from bytelayout.operators.validate import validate
from bytelayout.plans import convert
from bytelayout.plans.convert import convert_csv, convert_folder, convert_xlsx, error_files
from bytelayout.plans.synth import synthetic_rows, with_faults
from bytelayout.sources.fixed_width import read_fixed_width
from bytelayout.sources.sink import write_csv

from test_files_back import joined_parts
from test_sheets import write_xlsx


def short(file_id):
    return file_id.rsplit("/", 1)[1]


def test_convert_a_folder(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "Good.CSV").write_bytes("中,a\r\nb,\r\n".encode("big5"))
    (source / "utf16.csv").write_bytes(b"\xff\xfe" + "中,a\r\nb,\r\n".encode("utf-16le"))
    (source / "wide.csv").write_bytes(b"abcd,a\n" + b"b,c\n")
    (source / "broken.csv").write_bytes(b'a,b\n"c,d\n')
    (source / "empty.csv").write_bytes(b"")
    (source / "large.csv").write_bytes(b"a,b\n" * 2000)
    (source / "note.txt").write_bytes(b"a,b\n")
    write_xlsx(source / "book.xlsx", '<row r="1"><c r="A1"><v>12</v></c></row><row r="2"><c r="B2" t="b"><v>1</v></c></row>')
    layout = Layout.of_widths([3, 4], expected_rows=2)
    done = convert_csv(spark, str(source), layout, str(tmp_path / "out"), max_bytes=5000)
    assert joined_parts(tmp_path / "out" / "file=Good.txt") == "中 a   \r\nb      \r\n".encode("big5")
    assert joined_parts(tmp_path / "out" / "file=utf16.txt") == "中 a   \r\nb      \r\n".encode("big5")
    assert {path.name for path in (tmp_path / "out").glob("file=*")} == {"file=Good.txt", "file=utf16.txt"}
    assert {(short(r.file_id), r.code, r.source_row) for r in done.issues.collect()} == {
        ("wide.csv", "WIDTH_OVERFLOW", 1), ("broken.csv", "MALFORMED_CSV", 2),
        ("empty.csv", "MALFORMED_CSV", None), ("large.csv", "MALFORMED_CSV", None),
    }
    assert {(short(r.file_id), r.problem) for r in done.refused.collect()} == {
        ("empty.csv", "empty file"), ("large.csv", "file larger than the limit"),
        ("note.txt", "unsupported file type"),
    }
    assert {short(r.file_id) for r in error_files(done).collect()} == {
        "wide.csv", "broken.csv", "empty.csv", "large.csv",
    }
    books = convert_xlsx(spark, str(source), layout, str(tmp_path / "books"))
    assert joined_parts(tmp_path / "books" / "file=book.txt") == b"12     \r\n   TRUE\r\n"
    assert books.issues.isEmpty() and books.summary.first().output_size == 18


def test_convert_a_mixed_folder(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    (source / "one.csv").write_bytes(b"1,x\n2,y\n")
    (source / "wide.csv").write_bytes(b"12345,x\n")
    write_xlsx(source / "sub" / "two.xlsx", '<row r="1"><c r="A1"><v>3</v></c></row>')
    write_xlsx(source / "one.xlsx", '<row r="1"><c r="B1"><v>4</v></c></row>')
    (source / "torn.xlsx").write_bytes(b"PK")
    (source / "note.txt").write_bytes(b"1,x")
    layout = Layout.of_widths([3, 2])
    done = convert_folder(spark, str(source), layout, str(tmp_path / "out"))
    found = {(r.file_id, r.record_no): r.fields for r in read_fixed_width(spark, str(tmp_path / "out"), layout).collect()}
    assert found == {
        ("one.csv.txt", 1): ["1", "x"], ("one.csv.txt", 2): ["2", "y"], ("sub/two.txt", 1): ["3", ""],
        ("one.xlsx.txt", 1): ["", "4"],
    }
    assert {(short(r.file_id), r.code) for r in done.issues.collect()} == {
        ("wide.csv", "WIDTH_OVERFLOW"), ("torn.xlsx", "MALFORMED_SPREADSHEET"),
    }
    assert {short(r.file_id) for r in done.summary.collect()} == {"one.csv", "wide.csv", "one.xlsx", "two.xlsx"}
    assert {short(r.file_id) for r in done.refused.collect()} == {"note.txt"}
    lines_only = convert_folder(spark, str(source / "one.csv"), layout)
    assert [(short(r.file_id), r.actual_rows) for r in lines_only.summary.collect()] == [("one.csv", 2)]


def test_validation_runs_once(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    (source / "good.csv").write_bytes("".join(f"{k},x\n" for k in range(30_000)).encode())
    (source / "bad.csv").write_bytes(b"1,x\n2,much too wide\n")
    layout, counted = Layout.of_widths([6, 4]), spark.sparkContext.accumulator(0)

    def one_more(value):
        counted.add(1)
        return value

    passed_on = F.udf(one_more, "boolean")

    def watched(*args):
        checked = validate(*args)
        return checked.withColumn("valid", passed_on("valid"))

    monkeypatch.setattr(convert, "validate", watched)
    with splits_of(spark, "20k"):
        done = convert_csv(spark, str(source), layout, str(tmp_path / "out"), delimiter=",", newline="\n")
        assert done.issues.count() == 1 and done.validated.count() == 30_002
    assert counted.value == 30_002
    wanted = "".join(f"{k:<6}x   \r\n" for k in range(30_000)).encode()
    assert joined_parts(tmp_path / "out" / "file=good.txt") == wanted
    assert not (tmp_path / "out" / "file=bad.txt").exists()


@contextlib.contextmanager
def splits_of(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_synthetic_records(spark, tmp_path):
    layout = Layout.built_in().with_options(expected_rows=500)
    rows = synthetic_rows(spark.range(1, 501), "id", layout)
    checked = validate(rows, layout)
    assert issue_table(checked, layout).isEmpty()
    assert summarize(checked, layout).first().output_size == 500 * 210
    filled = rows.filter("source_row = 11").first().fields
    assert [len(filled[3].encode("big5")), len(filled[8].encode("big5"))] == [10, 120]
    write_csv(rows, str(tmp_path / "csv"))
    part = next((tmp_path / "csv").rglob("part-*.txt"))
    part.rename(part.with_suffix(".csv"))
    convert_csv(spark, str(tmp_path / "csv"), layout, str(tmp_path / "out"))
    back = read_fixed_width(spark, str(tmp_path / "out"), layout).orderBy("record_no").collect()
    assert [row.fields for row in back] == [row.fields for row in rows.orderBy("source_row").collect()]

    broken = validate(with_faults(rows.filter("source_row <= 60"), layout), layout)
    issues = issue_table(broken, layout.with_options(expected_rows=60)).collect()
    assert len(issues) == 60
    assert {(r.code, r.field_index) for r in issues} == {
        (code, at) for at in range(1, 16) for code in ("WIDTH_OVERFLOW", "UNENCODABLE_BIG5")
    }


def test_every_source_has_its_own_output(spark, tmp_path):
    for folder, text in (("a", b"1,x\n"), ("b/c d", b"2,y\n"), ("b", b"3,z\n")):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / "同 名+.csv").write_bytes(text)
    (tmp_path / "in" / "a" / "同 名+.CSV").write_bytes(b"4,w\n")
    layout = Layout.of_widths([2, 2])
    convert_csv(spark, str(tmp_path / "in"), layout, str(tmp_path / "out"))
    found = {row.file_id: row.fields for row in read_fixed_width(spark, str(tmp_path / "out"), layout).collect()}
    assert found == {
        "a/同 名+.csv.txt": ["1", "x"], "a/同 名+.CSV.txt": ["4", "w"], "b/c d/同 名+.txt": ["2", "y"], "b/同 名+.txt": ["3", "z"],
    }


def test_synthetic_records_of_one_small_split_are_made_by_many_tasks(spark, tmp_path):
    spark.range(1, 95_001).coalesce(1).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    assert ids.rdd.getNumPartitions() == 1
    made = synthetic_rows(ids, "id", Layout.of_widths([3]))
    assert made.rdd.getNumPartitions() == 10
    sizes = [row["n"] for row in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 95_000 and max(sizes) < 1.2 * 95_000 / 10

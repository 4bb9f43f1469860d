"""Encoding detection, framing and numbering of delimited files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from bytelayout.layout import Layout
from bytelayout.operators.reports import records, summarize
from bytelayout.operators.validate import validate
from bytelayout.sources import encoding, lines
from bytelayout.sources.csv import Grammar, read_csv
from bytelayout.sources.encoding import delimiter_of, newline_of, utf16_hint
from bytelayout.sources.files import admission_problem, file_type, list_files
from bytelayout.sources.lines import number_lines, scan_lines


def write(folder, **files):
    for name, data in files.items():
        (folder / f"{name}.csv").write_bytes(data)
    return str(folder)


def by_name(rows):
    found = {}
    for row in rows.orderBy("file_id", "source_row").collect():
        name = row.file_id.rsplit("/", 1)[1].removesuffix(".csv")
        found.setdefault(name, []).append((row.source_row, row.fields))
    return {name: [fields for _, fields in got] for name, got in found.items()
            if [number for number, _ in got] == list(range(1, len(got) + 1))}


def test_many_encodings_and_shapes(spark, tmp_path):
    folder = write(
        tmp_path,
        plain="a,b,c\r\n1,中文,3\r\n\r\n\"x,y\",\"q\"\"z\",\r\n".encode(),
        big5="a,b,c\n1,中文,3\n".encode("big5"),
        wide_le=b"\xff\xfe" + 'a,b\r\n"1\r\n2",中\r\n'.encode("utf-16le"),
        wide_be=b"\xfe\xff" + "a,b\n1,中".encode("utf-16be"),
        wide_guess="中a,bcdefghij\né,12345678ÿ\n".encode("utf-16le"),
        wide_broken=b"\xff\xfe" + "a,b\n".encode("utf-16le") + b"\x00\xd8",
        mark=b"\xef\xbb\xbfa;b;c\n1,5;2;3",
        mac=b"a|b\rc|d\r",
        empty=b"",
        inner_lf=b'"a\nb",c\r\n"d\n\ne",f\r\n',
        lone_lf=b"a,b\r\nc\nd,e\r\n",
        unclosed=b'a,b\n"x,c\nd,e\n',
        stray=b'a,b\n"x"y",c\nd,e\n',
        blank_after='a,b\n"x" ,"y"\t\n'.encode(),
        cut_big5=b"a,b\n\xa4",
        one_column=b"hello\nworld\n",
    )
    source = read_csv(spark, folder)
    files = {row["name"].removesuffix(".csv"): row for row in source.files.collect()}
    assert {name: row.encoding for name, row in files.items() if row.encoding != "utf-8"} == {
        "big5": "big5", "wide_le": "utf-16le", "wide_be": "utf-16be", "wide_guess": "utf-16le",
        "wide_broken": "utf-16le", "empty": None, "cut_big5": "big5",
    }
    assert files["mark"].label == "UTF-8 (byte order mark)" and not files["mark"].ambiguous
    assert files["mac"].ambiguous and files["wide_guess"].ambiguous
    assert {name for name, row in files.items() if row.problem} == {
        "empty", "wide_broken", "unclosed", "stray", "cut_big5", "one_column",
    }
    assert by_name(source.rows) == {
        "plain": [["a", "b", "c"], ["1", "中文", "3"], [""], ["x,y", 'q"z', ""]],
        "big5": [["a", "b", "c"], ["1", "中文", "3"]],
        "wide_le": [["a", "b"], ["1\r\n2", "中"]],
        "wide_be": [["a", "b"], ["1", "中"]],
        "wide_guess": [["中a", "bcdefghij"], ["é", "12345678ÿ"]],
        "mark": [["a", "b", "c"], ["1,5", "2", "3"]],
        "mac": [["a", "b"], ["c", "d"]],
        "inner_lf": [["a\nb", "c"], ["d\n\ne", "f"]],
        "lone_lf": [["a", "b"], ["c\nd", "e"]],
        "blank_after": [["a", "b"], ["x", "y"]],
    }
    issues = {
        (row.file_id.rsplit("/", 1)[1].removesuffix(".csv"), row.source_row)
        for row in source.issues.collect()
    }
    assert issues == {
        ("empty", None), ("wide_broken", None), ("cut_big5", None), ("one_column", None),
        ("unclosed", 2), ("stray", 2),
    }


@pytest.mark.parametrize("split_bytes", [1 << 27, 4096, 700])
def test_framing_against_csv_module(spark, tmp_path, split_bytes):
    """Random quoted text reads back the same however the file is split."""
    rng = random.Random(7)
    alphabet = ["a", "b", ",", '"', "\n", "\r\n", " ", "中", ""]
    data = [
        ["".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for _ in range(3)]
        for _ in range(1500)
    ]
    data[700] = ["x", "\n" * 3000, "y"]
    stream = io.StringIO()
    csv.writer(stream, lineterminator="\r\n").writerows(data)
    simple = "".join(f"{n},v{n},\r\n" for n in range(2000)).encode()
    folder = write(tmp_path, framed=stream.getvalue().encode(), simple=simple)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        source = read_csv(spark, folder, "utf-8", ",", "\r\n")
        got = by_name(source.rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert source.issues.isEmpty()
    assert got["framed"] == data
    assert got["simple"] == [[str(n), f"v{n}", ""] for n in range(2000)]


def test_line_numbers_do_not_depend_on_splits_or_join(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"".join(b"%d\n" % n for n in range(1, 5001)))
    (tmp_path / "b.txt").write_bytes(b"".join(b"%d\n" % n for n in range(1, 11)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        for size in (1 << 20, -1):
            numbered = number_lines(scan_lines(spark, str(tmp_path)), broadcast_bytes=size)
            wrong = numbered.filter(F.col("line").cast("string").cast("bigint") != F.col("line_no"))
            assert numbered.count() == 5010 and wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_end_to_end(spark, tmp_path):
    rows = [[str(n), "中", "a,b" if n % 2 else 'c"d'] for n in range(200)]
    stream = io.StringIO(newline="")
    csv.writer(stream).writerows(rows)
    source = read_csv(spark, write(tmp_path, made=stream.getvalue().encode()))
    layout = Layout.of_widths([10, 96, 102], expected_rows=200)
    checked = validate(source.rows, layout)
    assert summarize(checked, layout).first()["output_size"] == 42000
    assert records(checked, layout).filter("octet_length(record) <> 210").count() == 0
    assert source.files.first()["encoding"] == "utf-8"


@pytest.mark.parametrize(
    "head, expected",
    [("a\nb\r\nc", "\n"), ("a\r\nb\nc", "\r\n"), ("a\rb\rc", "\r"), ("abc", "\n"),
     ('"a\nb"\r\nc\r\n', "\r\n"), ("a\rb\r\nc\r\n", "\r\n")],
)
def test_newline(spark, head, expected):
    df = spark.createDataFrame([(head,)], "head string")
    assert df.select(newline_of(F.col("head")).alias("n")).first().n == expected


def test_delimiters(spark):
    cases = [
        ("a,b,c\n1,2,3\n", ","), ("a;b;c\n1,5;2;3\n", ";"), ("a\tb\n1\t2\n", "\t"),
        ("a|b\n1|2\n", "|"), ("abc\ndef\n", None), ('"a,b";c\n"d";e\n', ";"), ("a,b\nc\n", None),
    ]
    df = spark.createDataFrame(cases, "head string, expected string")
    got = df.select("expected", delimiter_of(F.col("head"), F.lit("\n"), F.lit(True)).alias("d"))
    assert [row.d for row in got.collect()] == [expected for _, expected in cases]


def test_utf16_hint(spark):
    cases = [
        ("plain text".encode("utf-16le"), "utf-16le"), ("plain text".encode("utf-16be"), "utf-16be"),
        (b"ab", None), (b"plain text", None), (b"\0\0\0\0", None), ("中文中文".encode("utf-16le"), None),
    ]
    df = spark.createDataFrame([(bytearray(head), e) for head, e in cases], "head binary, e string")
    assert [r.h for r in df.select(utf16_hint(F.col("head")).alias("h")).collect()] == [e for _, e in cases]


def test_long_lines_do_not_overflow_the_matcher(spark):
    grammar = Grammar(",")
    long = {
        "pairs": '"' + '""' * 400_000 + '",x', "fields": "a," * 400_000, "quoted": '"a",' * 250_000 + "z",
        "open": '"a",' * 250_000 + '"b', "stray": '"' + 'a"b' * 300_000,
    }
    df = spark.createDataFrame(list(long.items()), "name string, line string")
    line = F.col("line")
    got = {
        row.name: (row.o, row.g, row.n)
        for row in df.select(
            "name", line.rlike(grammar.open_from_outside).alias("o"),
            line.rlike(grammar.good_from_outside).alias("g"),
            F.size(grammar.parse(line)).alias("n"),
        ).collect()
    }
    assert got["pairs"] == (False, True, 2)
    assert got["fields"] == (False, True, 400_001)
    assert got["quoted"] == (False, True, 250_001)
    assert got["open"][:2] == (True, True)
    assert got["stray"][:2] == (True, False)


def test_file_types_and_admission(spark, tmp_path):
    names = ["data.csv", "DATA.XLS", "report.final.XLSX", "data.xlsm", "data.csv.txt", "csv", "a.csv\n"]
    df = spark.createDataFrame([(name, 10) for name in names], "name string, size bigint")
    got = df.select(file_type(F.col("name")).alias("t")).collect()
    assert [row.t for row in got] == ["csv", "xls", "xlsx", None, None, None, None]
    sizes = spark.createDataFrame([("csv", 0), ("csv", 11), ("csv", 10), (None, 0)], "t string, size bigint")
    problems = sizes.select(admission_problem(F.col("t"), F.col("size"), 10).alias("p")).collect()
    assert [row.p for row in problems] == [
        "empty file", "file larger than the limit", None, "unsupported file type",
    ]
    write(tmp_path, a=b"x", **{"b c": b""})
    listed = {row.name: (row.size, row.file_type) for row in list_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.csv": (1, "csv"), "b c.csv": (0, "csv")}


def test_first_records_longer_than_any_head(spark, tmp_path):
    lines = ['"' + "\n".join(f"{n},{k}" for k in range(1500)) + f'";b;{n}\n' for n in range(12)]
    wide = ["a\t" + "x" * 1_200_000 + f"\t{n}\n" for n in range(12)]
    folder = write(tmp_path, lines="".join(lines).encode(), wide="".join(wide).encode(), plain=b"a,b\n" * 20)
    source = read_csv(spark, folder)
    found = {row.name: (row.delimiter, row.records, row.problem) for row in source.files.collect()}
    assert found == {"lines.csv": (";", 12, None), "wide.csv": ("\t", 12, None), "plain.csv": (",", 20, None)}


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def splits(spark):
    yield lambda size: small_splits(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_each_file_is_split_at_its_own_line_end(spark, tmp_path, splits, monkeypatch):
    """A CR file is a single line to a scan for LF; it is not held, and the scan for CR does not touch the others."""
    rows = [[str(k), "x" * (k % 40), "中"] for k in range(3000)]
    ends = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}
    folder = write(tmp_path, **{name: "".join(",".join(row) + end for row in rows).encode() for name, end in ends.items()})
    monkeypatch.setattr(encoding, "LINE_LIMIT", 5000)
    splits("8192")
    kinds = encoding._evidence(lambda line_sep, files, limit: scan_lines(spark, folder, line_sep, files=files, limit=limit), list_files(spark, folder))
    assert [(line_sep, limit) for line_sep, limit, _, _ in kinds] == [("\n", 5000), ("\r", 5000)]
    source = read_csv(spark, folder)
    assert {row["name"]: row.newline for row in source.files.collect()} == {f"{name}.csv": end for name, end in ends.items()}
    assert by_name(source.rows) == dict.fromkeys(ends, rows)
    mine = source.files.where("newline = '\r'")
    scanned = scan_lines(spark, folder, "\r", files=mine)
    assert scanned.rdd.getNumPartitions() < 12 and scanned.agg(F.max(F.octet_length("line"))).first()[0] < 60
    monkeypatch.setattr(lines, "LISTED", 0)  # too many names for a list: the same rows without pruning
    assert by_name(read_csv(spark, folder).rows) == dict.fromkeys(ends, rows)


def test_lines_beyond_the_limit_in_every_way(spark, tmp_path, monkeypatch):
    rows = [["a" * 9000, "b"], ["c", "d" * 7000]] * 3
    folder = write(tmp_path, long="".join(",".join(row) + "\n" for row in rows).encode(), short=b"a,b\nc,d\n", mark=b"\xef\xbb\xbfa,b\nc,d")
    monkeypatch.setattr(encoding, "LINE_LIMIT", 4096)
    assert by_name(read_csv(spark, folder).rows) == {"long": rows, "short": [["a", "b"], ["c", "d"]], "mark": [["a", "b"], ["c", "d"]]}


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_utf16_in_many_splits(spark, tmp_path, splits, newline):
    """Both byte orders, marked or not, with line end bytes across two characters, next to each other and over split edges."""
    odd = {"le": "\u0a05\u4e00\u0d05\u4e00", "be": "\u4e00\u0a05\u4e00\u0d05"}
    files, expected = {}, {}
    for order in odd:
        for mark in ("", "\ufeff"):
            for strange in (False, True):
                name = f"{order}{len(mark)}{int(strange)}"
                value = lambda k: odd[order] * (1 + k % 3) if strange and k % 5 == 0 else "\ufeffx" if k == 7 else f"v{k}"  # noqa: B023, E731
                expected[name] = [[str(k), value(k), "plain text"] for k in range(400)]
                text = newline.join(",".join(row) for row in expected[name]) + (newline if mark else "")
                files[name] = (mark + text).encode(f"utf-16-{order}")
    folder = write(tmp_path, **files)
    for size in ("1000", "1 mb"):
        splits(size.replace(" ", ""))
        source = read_csv(spark, folder)
        assert {row["name"][:2] + row.encoding[-2:] for row in source.files.collect()} == {"lele", "bebe"}
        assert by_name(source.rows) == expected


def test_quotes_in_utf16_with_moved_lines(spark, tmp_path, splits):
    rows = [["a\u0a05\u4e00", 'x"\ny'], ["b", "\u0a06\u4e00\u0a07\u4e00"]] * 50
    text = "".join(",".join(f'"{field.replace(chr(34), chr(34) * 2)}"' for field in row) + "\n" for row in rows)
    folder = write(tmp_path, quoted=b"\xff\xfe" + text.encode("utf-16-le"))
    splits("300")
    assert by_name(read_csv(spark, folder).rows) == {"quoted": rows}


def test_big5_that_begins_like_a_mark(spark, tmp_path, splits):
    folder = write(
        tmp_path, whole=b"\xef\xbb\xbf\xa4\xa4\xa4,b\n\xa4\xa4,c\n", half=b"\xef\xbb\xbf\x41,b\nc,d\n", plain=b"\xa4\xa4,b\nc,d\n",
    )
    expected = {
        "whole": [[b"\xef\xbb\xbf\xa4\xa4\xa4".decode("big5hkscs"), "b"], ["\u4e2d", "c"]],
        "half": [[b"\xef\xbb\xbf\x41".decode("big5hkscs"), "b"], ["c", "d"]], "plain": [["\u4e2d", "b"], ["c", "d"]],
    }
    for size in ("7", "1mb"):
        splits(size)
        for options in ({}, {"delimiter": ",", "newline": "\n"}):
            assert by_name(read_csv(spark, folder, "big5", **options).rows) == expected


def test_big5_halved_by_the_head(spark, tmp_path):
    """Whether the cut of the head falls within a character makes no difference."""
    folder = write(tmp_path, **{f"f{k}": b"a" * k + "\u4e2d".encode("big5") * 700000 + b",b\nc,d\n" for k in range(2)})
    for preference in ("auto", "big5"):
        source = read_csv(spark, folder, preference)
        assert [row.problem for row in source.files.collect()] == [None, None]
        assert {name: [len(fields[0]) for fields in rows] for name, rows in by_name(source.rows).items()} == {"f0": [700000, 1], "f1": [700001, 1]}

"""Delimited text files as records, at any number and size of files.

Quotes make a line end ambiguous only where a line can end inside a quoted field.
Files in which no line does (nearly all) keep one record per line and are never
shuffled. The others are framed block by block: each line is a function on
{outside, inside}, blocks are composed into one such function each, a prefix over
those few rows tells how every block begins, and only then are the lines of a
block brought together once to be joined into records.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bytelayout.functions.charset import decode_big5, decode_utf8, decode_utf16
from bytelayout.operators.validate import ERROR
from bytelayout.plans.joins import fits_broadcast, join_small
from bytelayout.session import charset_flags, materialize
from bytelayout.sources import encoding as enc
from bytelayout.sources.files import EMPTY_FILE, TOO_LARGE, list_files
from bytelayout.sources.lines import first_lines, line_offset, rows_before, scan_lines, written_file

MALFORMED = "MALFORMED_CSV"

# Problem texts.
MISSING_QUOTES = "a quoted field is not closed"
INVALID_QUOTES = "a quote inside a quoted field is not doubled"
NO_DELIMITER = "no delimiter was found"
UNDECODABLE = enc.UNDECODABLE


@dataclass(frozen=True)
class CsvSource:
    """Result of `read_csv`.

    `files`: one row per file with encoding, line end, delimiter, number of records
    and `problem` (NULL when the file can be used). `rows`: records of the usable
    files. `issues`: MALFORMED_CSV rows of the others. `by_block`: whether the rows
    of one `block` still sit in one task in file order.
    """

    files: DataFrame
    rows: DataFrame
    issues: DataFrame
    by_block: bool


class Grammar:
    """Regular expressions of one delimiter. All loops are possessive: no backtracking."""

    def __init__(self, delimiter: str) -> None:
        d = f"\\x{ord(delimiter):02x}"
        # The whitespace allowed between a closing quote and what follows.
        blank = (
            "[\\t\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF&&[^"
            + d
            + "]]*+"
        )
        stop = f"(?=(?:{d}|\\z))"
        strict = '[^"]*+(?:""[^"]*+)*+'
        lenient = f'[^"]*+(?:(?:""|"(?!{blank}(?:{d}|\\z)))[^"]*+)*+'
        plain = f'(?!")[^{d}]*+'
        any_field = f'(?:"{lenient}"{blank}|{plain})'
        good_field = f'(?:"{strict}"{blank}{stop}|{plain})'
        any_run = f"(?:{any_field}{d})*+"
        good_run = f"(?:{good_field}{d})*+"
        good_end = f'(?:{good_field}\\z|"{strict}\\z)'
        self.delimiter = delimiter
        self.open_from_outside = f'\\A{any_run}"{lenient}\\z'
        self.open_from_inside = f'\\A{lenient}(?:\\z|"{blank}{d}{any_run}"{lenient}\\z)'
        self.good_from_outside = f"\\A{good_run}{good_end}"
        self.good_from_inside = f'\\A{strict}(?:\\z|"{blank}(?:\\z|{d}{good_run}{good_end}))'
        self.fields = f'{d}("{strict}"{blank}{stop}|{plain})'
        self.split = "\\|" if delimiter == "|" else delimiter

    def parse(self, record: Column) -> Column:
        """Fields of a well-formed record."""
        quoted = F.transform(
            F.regexp_extract_all(F.concat(F.lit(self.delimiter), record), F.lit(self.fields), F.lit(1)),
            lambda field: F.when(
                field.startswith('"'),
                F.replace(
                    F.regexp_replace(field, '\\A"|"[^"]*+\\z', ""), F.lit('""'), F.lit('"')
                ),
            ).otherwise(field),
        )
        return F.when(F.contains(record, F.lit('"')), quoted).otherwise(
            F.split(record, self.split, -1)
        )


def _by_delimiter(delimiters: Sequence[str], build) -> Column:
    """A CASE over the delimiters that occur; one expression when there is only one."""
    if len(delimiters) == 1:
        return build(Grammar(delimiters[0]))
    chosen: Column | None = None
    for delimiter in delimiters:
        test = F.col("delimiter") == delimiter
        value = build(Grammar(delimiter))
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen


def describe_csv(
    spark: SparkSession, path: str | list[str], encoding: str = "auto",
    delimiter: str | None = None, newline: str | None = None, glob: str | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Encoding, line end, delimiter and problem of every file, one small row each.

    What is given is not looked for: with encoding utf-8, a delimiter and a line end, no
    file is read here. Big5 files take one scan even so, since the reader hides three bytes
    of those that begin like a UTF-8 mark.
    """
    listed = list_files(spark, path, glob)
    scan = lambda line_sep, files, limit: scan_lines(spark, path, line_sep, glob, files, limit=limit)
    if encoding in ("utf-8", "big5") and delimiter and newline:
        marks = listed.select("file_id", F.lit(False).alias("utf8_mark"))
        if encoding == "big5":
            marks = enc.file_marks(scan, listed.where("size > 0"))
        found = marks.select(
            "file_id",
            F.lit(encoding).alias("encoding"),
            F.lit("UTF-8 (chosen)" if encoding == "utf-8" else "Big5 (chosen)").alias("label"),
            F.lit(False).alias("ambiguous"),
            F.lit(None).cast("string").alias("encoding_problem"),
            F.lit(newline).alias("newline"),
            F.lit(delimiter).alias("delimiter"),
            "utf8_mark",
        )
    else:
        found = enc.describe_files(scan, listed.where("size > 0"), encoding).drop("file_size")
        if newline:
            found = found.withColumn("newline", F.lit(newline))
        if delimiter:
            found = found.withColumn("delimiter", F.lit(delimiter))
    joined = listed.join(found, "file_id", "left")
    problem = (
        F.when(F.col("size") == 0, EMPTY_FILE)
        .when(F.col("size") > (2**63 - 1 if max_bytes is None else max_bytes), TOO_LARGE)
        .when(F.col("encoding_problem").isNotNull(), F.col("encoding_problem"))
        .when(F.col("delimiter").isNull(), NO_DELIMITER)
    )
    return materialize(
        joined.select(
            "file_id", "name", "size", "encoding", "label", "ambiguous", "newline", "delimiter",
            problem.alias("problem"), "utf8_mark",
        )
    )


def decoded_lines(
    spark: SparkSession, path: str | list[str], files: DataFrame,
    kinds: Sequence[tuple[str, str | None, bool]], glob: str | None = None,
) -> tuple[DataFrame, bool]:
    """Lines of the usable files, split at their own line end and strictly decoded; and whether all lie where they were read.

    `text` is NULL for a line that does not decode. `kinds` holds what occurs of line end, byte
    order of UTF-16 (else NULL), and Big5 with the bytes of a UTF-8 mark in front. Each kind
    gives a scan of its own files, so that no file is split at another one's line end.
    """
    parts, in_place = [], True
    columns = ["file_id", "block", "at", "delimiter", "newline", "text"]
    usable = F.col("problem").isNull()
    wide = F.when(F.col("encoding").isin(enc.UTF16LE, enc.UTF16BE), F.col("encoding"))
    hidden = (F.col("encoding") == enc.BIG5) & F.col("utf8_mark")
    with charset_flags(spark):
        for newline, order, marked in kinds:
            of_kind = usable & (F.col("newline") == newline) & wide.eqNullSafe(F.lit(order)) & (hidden == marked)
            of_kind = F.coalesce(of_kind, F.lit(False))
            mine = files.filter(of_kind).select("file_id", "encoding", "delimiter", "newline")
            line_sep = _wide_bytes(newline, order).decode("latin-1") if order else newline
            scanned = scan_lines(spark, path, line_sep, glob, mine, files.filter(~of_kind))
            lines = join_small(scanned, mine, ["file_id"], "inner", spread_by=F.col("at"))
            if order:
                lines, intact = _whole_units(lines, _wide_bytes(newline, order), order)
                in_place = in_place and intact
                text = decode_utf16(F.col("line"), order == enc.UTF16BE)
            else:
                if marked:
                    lines = _first_marked(lines).withColumn(
                        "line", F.when(F.col("first"), F.concat(F.lit(b"\xef\xbb\xbf"), F.col("line"))).otherwise(F.col("line"))
                    )
                text = F.when(F.col("encoding") == enc.UTF8, decode_utf8(F.col("line"))).otherwise(
                    decode_big5(F.col("line"))
                )
            parts.append(lines.withColumn("text", text).select(columns))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines, in_place


def _wide_bytes(newline: str, order: str) -> bytes:
    return newline.encode("utf-16-be" if order == enc.UTF16BE else "utf-16-le")


def _first_marked(lines: DataFrame) -> DataFrame:
    """Add `first`: whether a line is the first one of its file."""
    placed = join_small(lines, first_lines(lines), ["file_id"], "left", spread_by=F.col("at"))
    return placed.withColumn("first", (F.col("block") == 0) & (F.col("at") == F.col("first_at"))).drop("first_at")


def _whole_units(lines: DataFrame, line_sep: bytes, order: str) -> tuple[DataFrame, bool]:
    """UTF-16 lines without the byte order mark, cut at whole units only; and whether none had to move.

    The reader looks for the bytes of a line end at any place. Where it found them across two units,
    the piece before is an odd number of bytes long, and so is the piece that ends the line. So a piece
    goes on with the line before it if it follows an odd number of odd pieces. Blocks are composed by
    their number of odd pieces, and only files that have any are shuffled, by line.
    """
    odd = (F.octet_length("line") % 2).cast("int")
    blocks = materialize(lines.groupBy("file_id", "block").agg(F.sum(odd).alias("odd"), F.min("at").alias("first_at")))
    split = materialize(blocks.groupBy("file_id").agg(F.sum("odd").alias("odd")).where("odd > 0").select("file_id"))
    starts = blocks.where("block = 0").select("file_id", "first_at")
    placed = join_small(lines, starts, ["file_id"], "left", spread_by=F.col("at"))
    placed = placed.withColumn("first", (F.col("block") == 0) & (F.col("at") == F.col("first_at"))).drop("first_at")
    mark = b"\xfe\xff" if order == enc.UTF16BE else b"\xff\xfe"
    bare = F.when(F.col("first") & F.col("line").startswith(F.lit(mark)), F.substring("line", 3, 2**31 - 1))
    if split.isEmpty():
        return placed.withColumn("line", bare.otherwise(F.col("line"))), True

    intact = join_small(placed, split, ["file_id"], "left_anti", ready=True)
    pieces = join_small(placed, split, ["file_id"], "left_semi", spread_by=F.col("at"), ready=True)
    entered = materialize(blocks.join(split, "file_id").withColumn("entered", rows_before("odd")).select("file_id", "block", "entered"))
    order_in_block = W.partitionBy("file_id", "block").orderBy("at")
    earlier = F.coalesce(F.sum(odd).over(order_in_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = join_small(pieces, entered, ["file_id", "block"], "inner", ready=True)
    pieces = pieces.withColumn("starts", ((F.col("entered") + earlier) % 2 == 0).cast("int"))
    counts = materialize(pieces.groupBy("file_id", "block").agg(F.sum("starts").alias("starts")).withColumn("before", rows_before("starts")))
    pieces = join_small(pieces, counts.drop("starts"), ["file_id", "block"], "inner", ready=True)
    so_far = F.sum("starts").over(order_in_block.rowsBetween(W.unboundedPreceding, 0))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "at", F.hex("line").alias("hex")))), lambda piece: piece["hex"]),
        line_sep.hex(),
    )
    whole = pieces.withColumn("line_no", F.col("before") + so_far).groupBy("file_id", "line_no").agg(
        F.min("block").alias("block"), F.unhex(joined).alias("line"), F.max("first").alias("first"),
        *(F.first(name).alias(name) for name in ("encoding", "delimiter", "newline")),
    )
    both = intact.select("file_id", "block", "at", "line", "first", "encoding", "delimiter", "newline").unionByName(
        whole.withColumnRenamed("line_no", "at")
    )
    return both.withColumn("line", bare.otherwise(F.col("line"))), False


def _with_quote_states(lines: DataFrame, delimiters: Sequence[str]) -> DataFrame:
    """Add how each line behaves: opens from outside / inside, malformed from either."""
    text = F.coalesce(F.col("text"), F.lit(""))
    quoted = F.contains(text, F.lit('"'))

    def either(pattern: str, unquoted: bool, negate: bool = False) -> Column:
        def build(grammar: Grammar) -> Column:
            hit = text.rlike(getattr(grammar, pattern))
            return ~hit if negate else hit

        return F.when(quoted, _by_delimiter(delimiters, build)).otherwise(F.lit(unquoted))

    return (
        lines.withColumn("opens", either("open_from_outside", False))
        .withColumn("stays", either("open_from_inside", True))
        .withColumn("bad_outside", either("good_from_outside", False, negate=True))
        .withColumn("bad_inside", either("good_from_inside", False, negate=True))
    )


def _states_in_block(lines: DataFrame) -> DataFrame:
    """State before each line of a block, for a block entered outside and inside.

    A line with `opens == stays` fixes the state, one that only opens flips it, and
    the rest keep it. So the state is that of the last fixing line, turned once for
    every flip since.
    """
    order = W.partitionBy("file_id", "block").orderBy("at")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    flip = (F.col("opens") & ~F.col("stays")).cast("int")
    counted = lines.withColumn("_flips", F.sum(flip).over(order.rowsBetween(W.unboundedPreceding, 0)))
    fixed = F.last(
        F.when(
            F.col("opens") == F.col("stays"), F.struct(F.col("opens").alias("state"), "_flips")
        ),
        ignorenulls=True,
    ).over(earlier)
    so_far = F.coalesce(F.max("_flips").over(earlier), F.lit(0))
    marked = counted.withColumn("_fixed", fixed).withColumn("_so_far", so_far)
    turned = F.pmod(F.col("_so_far") - F.coalesce(F.col("_fixed._flips"), F.lit(0)), F.lit(2)) == 1

    def before(entered_inside: bool) -> Column:
        return F.coalesce(F.col("_fixed.state"), F.lit(entered_inside)) != turned

    return (
        marked.withColumn("before_o", before(False))
        .withColumn("before_i", before(True))
        .drop("_flips", "_fixed", "_so_far")
    )


def _framed_blocks(lines: DataFrame) -> DataFrame:
    """Each block as a function of the state it is entered in."""
    def after(before: Column) -> Column:
        return F.when(before, F.col("stays")).otherwise(F.col("opens"))

    def bad(before: Column) -> Column:
        return F.when(before, F.col("bad_inside")).otherwise(F.col("bad_outside"))

    narrow = lines.select("file_id", "block", "at", "opens", "stays", "bad_outside", "bad_inside")
    states = _states_in_block(narrow)
    per_block = states.groupBy("file_id", "block").agg(
        *[
            column
            for name in ("o", "i")
            for column in (
                F.max_by(after(F.col(f"before_{name}")), "at").alias(f"exit_{name}"),
                F.count_if(~F.col(f"before_{name}")).alias(f"starts_{name}"),
                F.count_if(bad(F.col(f"before_{name}"))).alias(f"bad_{name}"),
            )
        ]
    )
    as_lines = per_block.select(
        "*",
        F.lit(0).alias("_all"),
        F.col("exit_o").alias("opens"),
        F.col("exit_i").alias("stays"),
        F.col("block").alias("at"),
    )
    entered = _states_in_block(as_lines.withColumnRenamed("block", "_block").withColumnRenamed("_all", "block"))
    inside = F.col("before_o")
    return entered.select(
        "file_id",
        F.col("_block").alias("block"),
        inside.alias("entered_inside"),
        F.when(inside, F.col("exit_i")).otherwise(F.col("exit_o")).alias("left_inside"),
        F.when(inside, F.col("starts_i")).otherwise(F.col("starts_o")).alias("records"),
        F.when(inside, F.col("bad_i")).otherwise(F.col("bad_o")).alias("bad_lines"),
    )


BLOCK_COLUMNS = [
    "file_id", "block", "lines", "first_at", "records", "entered_inside", "left_inside",
    "bad_lines", "undecodable", "framed",
]


def describe_blocks(lines: DataFrame, delimiters: Sequence[str]) -> DataFrame:
    """Numbers and quote behaviour of every block, one small row each."""
    states = _with_quote_states(lines, delimiters)
    counts = materialize(
        states.groupBy("file_id", "block").agg(
            F.count(F.lit(1)).alias("lines"),
            F.min("at").alias("first_at"),
            F.count_if("opens").alias("openers"),
            F.count_if("bad_outside").alias("bad_lines"),
            F.count_if(F.col("text").isNull()).alias("undecodable"),
        )
    )
    openers = counts.groupBy("file_id").agg((F.sum("openers") > 0).alias("framed"))
    counts = counts.join(openers, "file_id")
    simple = counts.filter(~F.col("framed")).select(
        "file_id", "block", "lines", "first_at", F.col("lines").alias("records"),
        F.lit(False).alias("entered_inside"), F.lit(False).alias("left_inside"),
        "bad_lines", "undecodable", "framed",
    )
    framed_files = openers.filter("framed").select("file_id")
    if framed_files.isEmpty():
        blocks = simple
    else:
        mine = join_small(states, framed_files, ["file_id"], "left_semi", spread_by=F.col("at"))
        framed = _framed_blocks(mine).join(
            counts.filter("framed").drop("bad_lines"), ["file_id", "block"]
        )
        blocks = simple.select(BLOCK_COLUMNS).unionByName(framed.select(BLOCK_COLUMNS))
    return materialize(
        blocks.select(BLOCK_COLUMNS).withColumn("records_before", rows_before("records"))
    )


def _simple_records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """One record per line; no shuffle unless there are very many blocks."""
    placed = join_small(
        lines,
        blocks.select("file_id", "block", "lines", "first_at", "records_before"),
        ["file_id", "block"], "inner",
    )
    offset = line_offset(F.col("at"), F.col("first_at"), F.col("lines"))
    return placed.select(
        "file_id",
        (F.col("records_before") + offset + 1).alias("source_row"),
        F.col("text").alias("record"),
        "delimiter",
        "block",
    )


def _framed_lines(lines: DataFrame, blocks: DataFrame, delimiters: Sequence[str]) -> DataFrame:
    """Lines of framed files with their record number: one shuffle, by block."""
    placed = join_small(
        lines,
        blocks.select(
            "file_id", "block", "entered_inside", "left_inside", "records", "records_before"
        ),
        ["file_id", "block"], "inner",
    )
    states = _states_in_block(_with_quote_states(placed, delimiters))
    inside = F.when(F.col("entered_inside"), F.col("before_i")).otherwise(F.col("before_o"))
    order = W.partitionBy("file_id", "block").orderBy("at")
    starts = F.sum((~F.col("inside")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return states.withColumn("inside", inside).withColumn(
        "source_row", F.col("records_before") + starts
    )


def _framed_records(lines: DataFrame, blocks: DataFrame, delimiters: Sequence[str]) -> DataFrame:
    """Join the lines of each record; only records cut by a block edge move again."""
    numbered = _framed_lines(lines, blocks, delimiters)
    text = F.call_function(
        "array_join",
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "text"))), lambda line: line["text"]
        ),
        F.first("newline"),
    )
    pieces = numbered.groupBy("file_id", "block", "source_row").agg(
        text.alias("record"),
        F.first("newline").alias("newline"),
        F.first("delimiter").alias("delimiter"),
        (
            (F.first("records_before") == F.col("source_row"))
            | (
                F.first("left_inside")
                & (F.first("records_before") + F.first("records") == F.col("source_row"))
            )
        ).alias("cut"),
    )
    columns = ["file_id", "source_row", "record", "delimiter", "block"]
    joined = F.call_function(
        "array_join",
        F.transform(
            F.array_sort(F.collect_list(F.struct("block", "record"))), lambda piece: piece["record"]
        ),
        F.first("newline"),
    )
    merged = (
        pieces.filter("cut")
        .groupBy("file_id", "source_row")
        .agg(
            joined.alias("record"),
            F.first("delimiter").alias("delimiter"),
            F.min("block").alias("block"),
        )
    )
    return pieces.filter(~F.col("cut")).select(columns).unionByName(merged.select(columns))


def _issue(source_row: Column, problem: Column) -> list[Column]:
    where = F.when(
        source_row.isNotNull(), F.format_string("Row %d: ", source_row)
    ).otherwise("")
    return [
        F.col("file_id"),
        source_row.cast("bigint").alias("source_row"),
        F.lit(None).cast("int").alias("field_index"),
        F.lit(0).alias("seq"),
        F.lit(ERROR).alias("severity"),
        F.lit(MALFORMED).alias("code"),
        F.lit(None).cast("bigint").alias("actual"),
        F.lit(None).cast("bigint").alias("allowed"),
        F.concat(F.lit("Malformed CSV. "), where, problem, F.lit(".")).alias("message"),
    ]


def _quote_issues(lines: DataFrame, blocks: DataFrame, delimiters: Sequence[str]) -> DataFrame:
    """One issue per line with a stray quote, labelled with its record."""
    numbered = _framed_lines(lines, blocks, delimiters)
    bad = F.when(F.col("inside"), F.col("bad_inside")).otherwise(F.col("bad_outside"))
    return numbered.filter(bad).select(*_issue(F.col("source_row"), F.lit(INVALID_QUOTES)))


def read_csv(
    spark: SparkSession, path: str | list[str], encoding: str = "auto",
    delimiter: str | None = None, newline: str | None = None, glob: str | None = None,
    max_bytes: int | None = None,
) -> CsvSource:
    """Read delimited files; every record of a usable file, none of a malformed one.

    Nothing is trimmed, typed or skipped: blank lines, ragged records and the first
    line are records. Two or three jobs over the files run here (evidence, quote
    behaviour) and leave small checkpointed tables; `rows` itself is lazy.
    """
    files = describe_csv(spark, path, encoding, delimiter, newline, glob, max_bytes)
    usable = files.filter("problem is null")
    variants = usable.select(
        "newline", "delimiter", F.when(F.col("encoding").isin(enc.UTF16LE, enc.UTF16BE), F.col("encoding")).alias("order"),
        ((F.col("encoding") == enc.BIG5) & F.col("utf8_mark")).alias("hidden"),
    ).distinct().collect()  # at most 3 line ends x 6 delimiters x 4
    early = files.filter("problem is not null").select(
        *_issue(F.lit(None).cast("bigint"), F.col("problem"))
    )
    if not variants:
        rows = spark.createDataFrame(
            [], "file_id string, source_row bigint, fields array<string>, block bigint"
        )
        return CsvSource(files.withColumn("records", F.lit(0).cast("bigint")), rows, early, True)

    kinds = sorted({(row["newline"], row["order"], row["hidden"]) for row in variants}, key=str)
    delimiters = sorted({row["delimiter"] for row in variants})
    lines, in_place = decoded_lines(spark, path, files, kinds, glob)
    blocks = describe_blocks(lines, delimiters)

    ends = blocks.groupBy("file_id").agg(
        F.sum("records").alias("records"),
        (F.sum("undecodable") > 0).alias("undecodable"),
        (F.sum("bad_lines") > 0).alias("stray"),
        F.max_by("left_inside", "block").alias("unclosed"),
        F.max("framed").alias("framed"),
    )
    later = (
        F.when(F.col("undecodable"), UNDECODABLE)
        .when(F.col("unclosed"), MISSING_QUOTES)
        .when(F.col("stray"), INVALID_QUOTES)
    )
    files = materialize(
        files.join(ends, "file_id", "left").withColumn("problem", F.coalesce("problem", later))
    )
    good = files.filter("problem is null").select("file_id")
    good_blocks = blocks.join(good, "file_id", "left_semi")
    records = _simple_records(lines, good_blocks.filter(~F.col("framed")))
    any_framed = not files.filter("problem is null and framed").isEmpty()
    if any_framed:
        records = records.unionByName(
            _framed_records(lines, good_blocks.filter("framed"), delimiters)
        )
    rows = records.select(
        "file_id", "source_row",
        _by_delimiter(delimiters, lambda grammar: grammar.parse(F.col("record"))).alias("fields"),
        "block",
    )

    issues = early.unionByName(
        files.filter("undecodable").select(*_issue(F.lit(None).cast("bigint"), F.lit(UNDECODABLE)))
    ).unionByName(
        files.filter("unclosed and not undecodable").select(
            *_issue(F.col("records"), F.lit(MISSING_QUOTES))
        )
    )
    stray = files.filter("stray and not undecodable").select("file_id")
    if not stray.isEmpty():
        stray_blocks = blocks.join(stray, "file_id", "left_semi")
        issues = issues.unionByName(_quote_issues(lines, stray_blocks, delimiters))
    return CsvSource(
        files.select(
            "file_id", "name", "size", "encoding", "label", "ambiguous", "newline", "delimiter",
            "records", "problem",
        ),
        rows, issues, in_place and not any_framed and fits_broadcast(blocks),
    )


def whole_files(source: CsvSource) -> DataFrame:
    """The rows with `source_row` counted on over the parts of a file that `sink.write_records` wrote; other files stay.

    The records of every part are known already: a prefix sum over one row per part, and no second scan.
    """
    parts = source.files.where("problem IS NULL").withColumn("_file", written_file(F.col("file_id")))
    before = parts.select("file_id", rows_before("records", "file_id", "_file").alias("_before"))
    placed = join_small(source.rows, before, ["file_id"], "inner", spread_by=F.col("source_row"))
    return placed.withColumn("source_row", F.col("_before") + F.col("source_row")).drop("_before")


def first_parts(files: DataFrame) -> DataFrame:
    """Of the rows per file those of first parts, which hold the marks, and of files without parts."""
    first = files.groupBy(written_file(F.col("file_id")).alias("_file")).agg(F.min("file_id").alias("file_id"))
    return files.join(first.select("file_id"), "file_id", "left_semi")

"""Source encoding, line end and delimiter of every file.

Two scans give one small row per file: an aggregation over all lines (validity,
ASCII, byte counts) and the head of each file (byte order marks, zero bytes, line
end, delimiter). The answers follow by plain expressions. Both scans split files at
LF and hold no more than `LINE_LIMIT` bytes of a line; files with longer ones are
looked at again, split at CR, and only those long in that way too are read with lines
of any length.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bytelayout.functions.charset import BIG5 as BIG5_CHARSET
from bytelayout.functions.charset import decode_big5
from bytelayout.session import charset_flags, materialize

UTF8, UTF16LE, UTF16BE, BIG5 = "utf-8", "utf-16le", "utf-16be", "big5"

LF, CRLF, CR = "\n", "\r\n", "\r"

# Delimiters that are tried, in this order.
DELIMITERS = (",", "\t", "|", ";", "\x1e", "\x1f")

# Sample and thresholds of the test for UTF-16 without a mark.
HINT_BYTES = 4096
HINT_MANY = 0.2
HINT_FEW = 0.05

UNDECODABLE = "the bytes are not valid in the source encoding"

# How much of a file is looked at first: of lines no more than
# spark.sql.optimizer.windowGroupLimitThreshold, up to which Spark trims each map task to its
# first rows before the shuffle. Files whose first records are longer are looked at again,
# with so many times as much, up to what one value can hold.
HEAD_LINES = 1000
HEAD_BYTES = 1024 * 1024
HEAD_GROWTH = 16
HEAD_MOST = 1 << 30
SAMPLE_RECORDS = 10

# Longest line of a first look; a file with CR ends is one line to a scan for LF.
LINE_LIMIT = 16 << 20

# The raw lines of files: by line separator, restriction to files (`file_id`) and limit of a line.
Scan = Callable[[str, DataFrame | None, int | None], DataFrame]


def file_evidence(lines: DataFrame) -> DataFrame:
    """What all lines of a file say about its encoding.

    The reader takes a UTF-8 mark away without a word, so it shows only in the
    sizes: the file is three bytes longer than its lines and line ends. `covered` tells
    that nothing else is missing. Big5 is judged on whole lines, and only on those that
    are no UTF-8.
    """
    valid = F.is_valid_utf8(F.col("line").cast("string"))
    spare = F.max("file_size") - F.sum(F.octet_length("line")) - F.count(F.lit(1))
    with charset_flags(lines.sparkSession):
        big5 = F.when(valid, F.lit(True)).otherwise(decode_big5(F.col("line")).isNotNull())
        return lines.groupBy("file_id").agg(
            F.max("file_size").alias("file_size"),
            F.count(F.lit(1)).alias("raw_lines"),
            F.every(valid).alias("utf8_valid"),
            F.every(valid & (F.octet_length("line") == F.length(F.col("line").cast("string")))).alias("ascii_only"),
            # The first line may lack three bytes; it is judged when it is decoded.
            (F.count_if(~big5) == F.when((spare >= 2) & F.min_by(~big5, F.struct("block", "at")), 1).otherwise(0)).alias("big5_valid"),
            (spare >= 2).alias("utf8_mark"),
            spare.isin(0, 3).alias("terminated"),
            (spare.isin(-1, 0, 2, 3) & (F.max(F.octet_length("line")) < LINE_LIMIT)).alias("covered"),
        )


def file_heads(
    lines: DataFrame, head_lines: int = HEAD_LINES, head_bytes: int = HEAD_BYTES, line_sep: str = LF
) -> DataFrame:
    """The first lines of each file as one binary value of about `head_bytes`.

    The rank filter trims every map task to the head lines before the shuffle.
    """
    order = W.partitionBy("file_id").orderBy("block", "at")
    first = (
        lines.select("file_id", "block", "at", F.substring("line", 1, head_bytes).alias("line"))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= head_lines)
        .withColumn(
            "_size",
            F.coalesce(
                F.sum(F.octet_length("line") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .filter(F.col("_size") < head_bytes)
    )
    hexed = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", F.hex("line").alias("line")))),
            lambda entry: F.concat(entry["line"], F.lit(line_sep.encode().hex())),
        ),
        "",
    )
    return first.groupBy("file_id").agg(
        F.unhex(hexed).alias("head"), F.count(F.lit(1)).alias("head_lines")
    )


def utf16_hint(head: Column) -> Column:
    """Byte order of UTF-16 without a mark, judged by where the zero bytes are."""
    size = F.least(F.octet_length(head) - F.octet_length(head) % 2, F.lit(HINT_BYTES))
    pairs = (size / 2).cast("int")
    places = F.sequence(F.lit(0), pairs - 1)

    def zeros(offset: int) -> Column:
        hits = F.filter(
            places, lambda i: F.substring(head, i * 2 + 1 + offset, F.lit(1)) == F.lit(b"\0")
        )
        return F.size(hits) / pairs

    even, odd = zeros(0), zeros(1)
    return F.when(
        size >= 4,
        F.when((odd > HINT_MANY) & (even < HINT_FEW), UTF16LE).when(
            (even > HINT_MANY) & (odd < HINT_FEW), UTF16BE
        ),
    )


def _with(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build` applied to a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def newline_of(head: Column) -> Column:
    """Line end of a file from its head, quoted text left out.

    LF if that comes first; else CRLF if at least half of the pieces between CRs
    begin with LF; else CR.
    """
    def judge(bare: Column) -> Column:
        returns = F.length(bare) - F.length(F.replace(bare, F.lit(CR), F.lit("")))
        pairs = (F.length(bare) - F.length(F.replace(bare, F.lit(CRLF), F.lit("")))) / 2
        first_lf, first_cr = F.locate(LF, bare), F.locate(CR, bare)
        return (
            F.when(first_cr == 0, LF)
            .when((first_lf > 0) & (first_lf < first_cr), LF)
            .when(pairs >= (returns + 1) / 2, CRLF)
            .otherwise(CR)
        )

    return _with(F.regexp_replace(head, '"[^"]*+"', ""), judge)


def _single_line_ends(head: Column, newline: Column) -> Column:
    """The head with its own line end as LF and other CR or LF as blanks."""
    crlf = F.replace(F.regexp_replace(head, "(?<!\\r)\\n", " "), F.lit(CRLF), F.lit(LF))
    cr = F.replace(F.replace(head, F.lit(LF), F.lit(" ")), F.lit(CR), F.lit(LF))
    return F.when(newline == CRLF, crlf).when(newline == CR, cr).otherwise(head)


def delimiter_of(head: Column, newline: Column, whole: Column) -> Column:
    """Delimiter of a head, see `delimiter_choice`; NULL when none qualifies."""
    return delimiter_choice(head, newline, whole)["delimiter"]


def delimiter_choice(head: Column, newline: Column, whole: Column) -> Column:
    """Delimiter whose number of fields varies least over the first ten records, and `enough`.

    A candidate needs about two fields per record on average; a later one wins only
    if it varies no more and has more fields. NULL when none qualifies. `whole`
    tells that the head is the full file, so that its last record counts too; `enough`
    that the head holds the whole sample for every candidate.
    """
    def judged(text: Column, delimiter: str) -> Column:
        d = f"\\x{ord(delimiter):02x}"
        quoted = '"[^"]*+(?:""[^"]*+)*+"[^' + d + "\\n]*+"
        field = f'(?:{quoted}|(?!")[^{d}\\n]*+)'
        record = f"(?:{field}{d})*+{field}(?:\\n|\\z)"
        # One record more than the sample tells that the last sampled one is complete.
        sample = F.regexp_extract(text, f"\\A(?:{record}){{0,{SAMPLE_RECORDS + 1}}}+", 0)
        found = F.filter(F.regexp_extract_all(sample, F.lit(f"({record})")), lambda r: r != "")

        def complete(records: Column) -> Column:
            return F.when(whole | (F.size(records) > SAMPLE_RECORDS), records).otherwise(
                F.slice(records, F.lit(1), F.greatest(F.size(records) - 1, F.lit(1)))
            )

        def counted(records: Column) -> Column:
            counts = F.transform(
                F.slice(complete(records), 1, SAMPLE_RECORDS),
                lambda r: F.regexp_count(r, F.lit(f"\\G{field}{d}")) + 1,
            )
            return _with(counts, lambda numbers: judge(numbers, whole | (F.size(records) > SAMPLE_RECORDS)))

        def judge(numbers: Column, enough: Column) -> Column:
            following = F.slice(numbers, F.lit(2), F.greatest(F.size(numbers) - 1, F.lit(0)))
            steps = F.zip_with(
                following, F.slice(numbers, F.lit(1), F.size(following)), lambda a, b: F.abs(a - b)
            )
            return F.struct(
                F.lit(delimiter).alias("delimiter"),
                F.aggregate(steps, F.lit(0), lambda total, n: total + n).alias("change"),
                F.try_divide(
                    F.aggregate(numbers, F.lit(0), lambda total, n: total + n), F.size(numbers)
                ).alias("mean"),
                F.coalesce(enough, F.lit(False)).alias("enough"),
            )

        return _with(found, counted)

    def better(best: Column, other: Column) -> Column:
        wins = (other["mean"] > 1.99) & (
            best["delimiter"].isNull()
            | ((other["change"] <= best["change"]) & (other["mean"] > best["mean"]))
        )
        return F.when(wins, other).otherwise(best)

    nothing = F.struct(
        F.lit(None).cast("string").alias("delimiter"),
        F.lit(None).cast("int").alias("change"),
        F.lit(None).cast("double").alias("mean"),
        F.lit(None).cast("boolean").alias("enough"),
    )

    def choose(judgements: Column) -> Column:
        return F.struct(
            F.aggregate(judgements, nothing, better)["delimiter"].alias("delimiter"),
            F.forall(judgements, lambda judgement: judgement["enough"]).alias("enough"),
        )

    return _with(
        _single_line_ends(head, newline),
        lambda text: _with(F.array(*[judged(text, delimiter) for delimiter in DELIMITERS]), choose),
    )


def resolve_encoding(files: DataFrame, preference: str = "auto") -> DataFrame:
    """Add `encoding`, `label`, `ambiguous` and `encoding_problem` to file evidence.

    `files` holds the columns of `file_evidence` and the binary `head`. Whether all
    bytes really decode is found when lines are decoded; here only the choice.
    """
    head = F.col("head")
    le_mark, be_mark = head.startswith(F.lit(b"\xff\xfe")), head.startswith(F.lit(b"\xfe\xff"))
    hint = utf16_hint(head)

    def answer(encoding: Column | str, label: Column | str, ambiguous: Column | bool = False) -> Column:
        return F.struct(
            (F.lit(encoding) if isinstance(encoding, str) else encoding).alias("encoding"),
            (F.lit(label) if isinstance(label, str) else label).alias("label"),
            (F.lit(ambiguous) if isinstance(ambiguous, bool) else ambiguous).alias("ambiguous"),
        )

    marked16 = F.when(be_mark, UTF16BE).when(le_mark, UTF16LE)
    if preference == "utf-8":
        chosen = answer(UTF8, "UTF-8 (chosen)")
    elif preference == "big5":
        chosen = answer(BIG5, "Big5 (chosen)")
    elif preference == "utf-16":
        order = F.coalesce(marked16, hint)
        chosen = answer(
            order, F.concat(F.upper(order), F.lit(" (chosen)")), ~(le_mark | be_mark)
        )
    elif preference == "auto":
        chosen = (
            F.when(F.col("utf8_mark"), answer(UTF8, "UTF-8 (byte order mark)"))
            .when(le_mark, answer(UTF16LE, "UTF-16LE (byte order mark)"))
            .when(be_mark, answer(UTF16BE, "UTF-16BE (byte order mark)"))
            .when(F.col("ascii_only"), answer(UTF8, "ASCII (read as UTF-8)", True))
            .when(F.col("utf8_valid"), answer(UTF8, "UTF-8 (detected)"))
            .when(hint.isNotNull(), answer(hint, F.concat(F.upper(hint), F.lit(" (guessed)")), True))
            .otherwise(answer(BIG5, "Big5 (detected)"))
        )
    else:
        raise ValueError(f"unknown source encoding {preference!r}")
    return (
        files.withColumn("_chosen", chosen)
        .select("*", "_chosen.*")
        .drop("_chosen")
        .withColumn(
            "encoding_problem",
            F.when(F.col("encoding").isNull(), "UTF-16 without a byte order mark and no clear byte order"),
        )
    )


def head_text(head: Column, encoding: Column) -> Column:
    """The head decoded without strictness, for finding line ends and delimiters."""
    decoded = (
        F.when(encoding == UTF8, head.cast("string"))
        .when(encoding == UTF16LE, F.decode(head, "UTF-16LE"))
        .when(encoding == UTF16BE, F.decode(head, "UTF-16BE"))
        .otherwise(F.decode(head, BIG5_CHARSET))
    )
    return F.ltrim(decoded, F.lit("\ufeff"))


def describe_files(scan: Scan, files: DataFrame, preference: str = "auto") -> DataFrame:
    """One row for each of the `files` with a line: encoding, line end and delimiter, from raw lines.

    The first ten records decide, however long they are: files whose head does not hold
    them are looked at again with a larger one.
    """
    found = None
    for line_sep, limit, evidence, pending in _evidence(scan, files):
        head_lines, head_bytes = HEAD_LINES, HEAD_BYTES
        while True:
            last = head_bytes >= HEAD_MOST
            heads = file_heads(scan(line_sep, pending, limit), head_lines, head_bytes, line_sep)
            described = materialize(_described(evidence, heads, preference, last))
            done = described.filter("_enough").drop("_enough")
            found = done if found is None else found.unionByName(done)
            pending = described.filter("NOT _enough").select("file_id")
            if last or pending.isEmpty():
                break
            head_lines, head_bytes = head_lines * HEAD_GROWTH, head_bytes * HEAD_GROWTH
    return found


def _evidence(scan: Scan, files: DataFrame) -> list[tuple[str, int | None, DataFrame, DataFrame | None]]:
    """Separator, limit, evidence and names (None for all files) of each kind of file.

    Lines that are too long may be missing from a scan altogether, and so may a file.
    """
    kinds, pending = [], None
    for line_sep, limit in ((LF, LINE_LIMIT), (CR, LINE_LIMIT), (LF, None)):
        evidence = materialize(file_evidence(scan(line_sep, pending, limit)))
        kind = evidence if limit is None else evidence.filter("covered")
        left = (files if pending is None else pending).select("file_id").join(kind.select("file_id"), "file_id", "left_anti")
        left = materialize(left)
        done = left.isEmpty()
        if (done and not kinds) or not kind.isEmpty():
            kinds.append((line_sep, limit, kind, None if done and not kinds else kind.select("file_id")))
        if done:
            break
        pending = left
    return kinds


def file_marks(scan: Scan, files: DataFrame) -> DataFrame:
    """`file_id` and `utf8_mark` of every one of the `files` with a line."""
    kinds = [evidence.select("file_id", "utf8_mark") for _, _, evidence, _ in _evidence(scan, files)]
    return functools.reduce(DataFrame.unionByName, kinds)


def _described(evidence: DataFrame, heads: DataFrame, preference: str, last: bool) -> DataFrame:
    with charset_flags(evidence.sparkSession):
        known = resolve_encoding(evidence.join(heads, "file_id"), preference)
        whole = F.col("raw_lines") == F.col("head_lines")
        cut = F.when(
            whole & ~F.col("terminated"),
            F.substring("head", F.lit(1), F.octet_length("head") - 1),
        ).otherwise(F.col("head"))
        hidden = (F.col("encoding") == BIG5) & F.col("utf8_mark")
        bytes_of_head = F.when(hidden, F.concat(F.lit(b"\xef\xbb\xbf"), cut)).otherwise(cut)
        text = known.withColumn("_whole", whole).withColumn(
            "_head", head_text(bytes_of_head, F.col("encoding"))
        )
        broken = ((F.col("encoding") == UTF8) & ~F.col("utf8_valid")) | (
            (F.col("encoding") == BIG5) & ~F.col("big5_valid")
        )
        ended = text.withColumn("newline", newline_of(F.col("_head"))).withColumn(
            "encoding_problem", F.when(broken, UNDECODABLE).otherwise(F.col("encoding_problem"))
        )
        chosen = ended.withColumn("_choice", delimiter_choice(F.col("_head"), F.col("newline"), F.col("_whole")))
        enough = F.col("encoding_problem").isNotNull() | F.col("_whole") | F.col("_choice.enough") | F.lit(last)
        return chosen.withColumn("delimiter", F.col("_choice.delimiter")).withColumn(
            "_enough", F.coalesce(enough, F.lit(True))
        ).drop("head", "_head", "_whole", "head_lines", "_choice", "covered", "big5_valid")

"""Raw lines of many files, numbered without sorting or shuffling them.

The text source splits large files into blocks and hands out the undecoded bytes
of every line. Within a block the row ids of one task grow by one per line, so a
line number is the lines of all earlier blocks plus the distance from the first
id of its own block. Only one row per block takes part in the prefix sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bytelayout.plans.joins import join_small
from bytelayout.sources.files import file_options


# Files that a scan is restricted to by name; beyond it their lines are joined away.
LISTED = 10_000
# A part of a file that `sink.write_records` wrote.
PART = "/file=[^/]*/part=[^/]*/[^/]*\\z"


def scan_lines(
    spark: SparkSession, path: str | list[str], line_sep: str = "\n", glob: str | None = None,
    files: DataFrame | None = None, others: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """`file_id`, `block` (first byte of the split), `at` (order in it), `line` (bytes).

    With `files` only those are read, with `others` all but those, whichever table names no more
    than `LISTED`; with more, all files are read and those of `files` kept. Of a line longer
    than `limit` bytes no more than about so much is held at a time, and some of it is missing.
    """
    reader = spark.read.option("lineSep", line_sep).options(**file_options(glob))
    if limit is not None:
        reader = reader.option("mapreduce.input.linerecordreader.line.maxlength", limit)
    text, named = reader.text(path), F.col("_metadata.file_path")
    listed = _names(files)
    if listed is not None:
        text = text.where(named.isin(listed) if listed else F.lit(False))
    else:
        unlisted = _names(others)
        if unlisted:
            text = text.where(~named.isin(unlisted))
    lines = text.select(
        named.alias("file_id"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("line"),
    )
    if files is not None and listed is None:
        lines = join_small(lines, files.select("file_id"), ["file_id"], "left_semi", spread_by=F.col("at"))
    return lines


def _names(files: DataFrame | None) -> list[str] | None:
    if files is None:
        return None
    names = [row.file_id for row in files.select("file_id").limit(LISTED + 1).collect()]
    return names if len(names) <= LISTED else None


def written_file(path: Column) -> Column:
    """The folder that holds the parts of a written file; any other file is its own."""
    return F.when(path.rlike(PART), F.regexp_replace(path, "/part=[^/]*/[^/]*\\z", "")).otherwise(path)


def first_lines(lines: DataFrame) -> DataFrame:
    """`file_id` and `first_at`, the id of the first line of every file."""
    return lines.where("block = 0").groupBy("file_id").agg(F.min("at").alias("first_at"))


def rows_before(count: str, order: str = "block", file: str = "file_id") -> Column:
    """Sum of `count` over the earlier blocks of the same file."""
    window = W.partitionBy(file).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def block_counts(lines: DataFrame) -> DataFrame:
    """Lines per block and the id of the first, one small row per block."""
    return lines.groupBy("file_id", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("at").alias("first_at")
    )


def line_offset(at: Column, first_at: Column, lines: Column) -> Column:
    """Position of a line in its block, from 0.

    Fails when the file was split differently in the counting scan (split settings
    changed in between) rather than giving wrong numbers.
    """
    offset = at - first_at
    return F.when((offset >= 0) & (offset < lines), offset).otherwise(
        F.raise_error(F.lit("file blocks changed between two scans")).cast("bigint")
    )


def number_lines(lines: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """Add `line_no`, 1 to n in each file; part files of `sink.write_records` count on as one file."""
    blocks = block_counts(lines).withColumns({"_file": written_file(F.col("file_id")), "_order": F.struct("file_id", "block")})
    blocks = blocks.withColumn("_before", rows_before("lines", "_order", "_file")).drop("_file", "_order")
    options = {} if broadcast_bytes is None else {"broadcast_bytes": broadcast_bytes}
    placed = join_small(lines, blocks, ["file_id", "block"], "inner", **options)
    return placed.withColumn(
        "line_no",
        F.col("_before") + line_offset(F.col("at"), F.col("first_at"), F.col("lines")) + 1,
    ).drop("_before", "first_at", "lines")

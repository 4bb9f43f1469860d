"""Byte-exact fixed-width and CSV files, and report files.

The text writer puts out the bytes of a string column as they are, and a cast from
binary to string does not touch them, so Big5 records leave the JVM unchanged with
Spark's own committers. A file becomes a directory of part files; their name order
is the record order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bytelayout.functions import text
from bytelayout.layout import Layout
from bytelayout.operators.reports import records
from bytelayout.plans.joins import fits_broadcast, join_small
from bytelayout.session import materialize

ROWS_PER_PART = 1_000_000


def file_name(file_id: Column) -> Column:
    """Last part of a file path."""
    return F.regexp_extract(file_id, "([^/]*)\\z", 1)


def source_path(file_id: Column) -> Column:
    """Decoded path or address of a source file, without the scheme of local files."""
    return F.regexp_replace(F.url_decode(F.replace(file_id, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def relative_path(spark: SparkSession, path: str | list[str], file_id: Column) -> Column:
    """Path of a source file below the folder that was read; of a file read by itself, its name."""
    found, whole = file_name(source_path(file_id)), source_path(file_id)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for one in [path] if isinstance(path, str) else path:
        plain = re.match(r"(?:[^*?\[{]*/)?(?=[^/]*[*?\[{])|.*", one).group(0) or "."
        root = hadoop(plain)
        system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        root = re.sub("^file:/+", "/", system.makeQualified(root).toString()).rstrip("/") + "/"
        found = F.when(F.startswith(whole, F.lit(root)), F.substr(whole, F.lit(len(root) + 1))).otherwise(found)
    return found


def output_names(summary: DataFrame, source_name: Column | None = None) -> DataFrame:
    """`file_id` and output `name` of the files without errors, no two the same.

    The name is that of the source (its path below the folder that was read, where
    `source_name` gives it) with `.txt` for its extension. Sources that only differ in
    the extension keep it; sources that still agree are named by their whole path.
    """
    source = file_name(source_path(F.col("file_id"))) if source_name is None else source_name
    found = summary.filter(F.col("error_count") == 0).select("file_id", source.alias("_source"))
    found = found.withColumn("name", text.output_name(F.col("_source")))
    for fallback in (F.concat("_source", F.lit(".txt")), F.concat(source_path(F.col("file_id")), F.lit(".txt"))):
        alike = F.count(F.lit(1)).over(W.partitionBy("name"))
        found = found.withColumn("_alike", alike).withColumn("name", F.when(F.col("_alike") > 1, fallback).otherwise(F.col("name")))
    return found.select("file_id", "name")


def write_records(
    rows: DataFrame, path: str, record: str = "record", rows_per_part: int = ROWS_PER_PART,
    by_block: bool = False, in_place: bool = False, line_sep: str = "\r\n", mode: str = "errorifexists",
) -> None:
    """Write `record` of each file in `source_row` order below `path`/file=.../part=....

    Every part holds `rows_per_part` consecutive records, so a very large file is
    spread over many tasks and tasks need no sampling of the data. With `by_block`
    every `block` of a source file becomes one part instead; `in_place` says that the
    rows of each block still lie in one task, so that nothing is shuffled for it.
    """
    if by_block:
        part = F.col("block")
    else:
        part = F.floor((F.col("source_row") - 1) / rows_per_part)
    named = rows.select(
        F.col("file_id").alias("file"),
        F.lpad(part.cast("string"), 20, "0").alias("part"),
        "source_row",
        F.col(record).cast("string").alias("value"),
    )
    placed = named if by_block and in_place else named.repartition("file", "part")
    (
        placed.sortWithinPartitions("file", "part", "source_row")
        .select("file", "part", "value")
        .write.option("lineSep", line_sep)
        .partitionBy("file", "part")
        .mode(mode)
        .text(path)
    )


def write_fixed_width(
    validated: DataFrame, summary: DataFrame, layout: Layout, path: str,
    rows_per_part: int = ROWS_PER_PART, by_block: bool = False, mode: str = "errorifexists",
    source_name: Column | None = None, whole_blocks: bool = True,
) -> None:
    """Write the files without errors; a file with any error gives no output.

    Every source file has an output of its own, see `output_names`. `whole_blocks` says
    that the rows of a block lie in one task, as they do straight after reading; rows
    read back from a written table need not, and are shuffled by block.
    """
    names = materialize(output_names(summary, source_name))
    passed = join_small(validated, names, ["file_id"], "inner", spread_by=F.col("source_row"), ready=True)
    output = records(passed, layout, line_end=False).withColumn("file_id", F.col("name"))
    in_place = by_block and whole_blocks and fits_broadcast(names)
    write_records(output, path, rows_per_part=rows_per_part, by_block=by_block, in_place=in_place, mode=mode)


def write_csv(
    rows: DataFrame, path: str, delimiter: str = ",", rows_per_part: int = ROWS_PER_PART,
    mode: str = "errorifexists",
) -> None:
    """Write records as CSV with quotes only where needed and CRLF line ends."""
    output = rows.withColumn("record", text.csv_record(F.col("fields"), delimiter))
    write_records(output, path, rows_per_part=rows_per_part, mode=mode)


def write_report(issues: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write an issue table, as Parquet or as CSV with a header."""
    writer = issues.write.mode(mode)
    if file_format == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.format(file_format).save(path)

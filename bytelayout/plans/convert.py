"""From source files to fixed-width files in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelayout.functions.charset import BIG5
from bytelayout.layout import Layout
from bytelayout.operators.reports import ISSUE_COLUMNS, issue_table, summarize
from bytelayout.operators.validate import ERROR, validate
from bytelayout.session import materialize, staged
from bytelayout.sources.csv import read_csv
from bytelayout.sources.files import admit_files, list_files
from bytelayout.sources.sink import ROWS_PER_PART, relative_path, write_fixed_width
from bytelayout.sources.xlsx import read_xlsx


CSV_NAMES = "*.[cC][sS][vV]"


@dataclass(frozen=True)
class Conversion:
    """What became of a folder of source files.

    `summary` has a row for every file that could be parsed, `issues` every problem
    of parsing and validation, `refused` the files that were not read. Parsing and
    validation ran once: `validated` is read from the shared folder.
    """

    validated: DataFrame
    summary: DataFrame
    issues: DataFrame
    refused: DataFrame


def _convert(
    layout: Layout, rows: DataFrame, parsed: DataFrame, malformed: DataFrame, refused: DataFrame,
    charset: str, output: str | None, mode: str, path: str | list[str], by_block: bool = False,
) -> Conversion:
    """Validate once into the shared folder; counts, gate, files and issues are all read from there.

    Whether a file may be written is known only after its last record, and records cannot
    wait in memory for it, so they are written down with their verdicts.
    """
    validated = staged(validate(rows, layout, charset), "validated")
    summary = materialize(summarize(validated, layout, parsed))
    if output is not None:
        name = relative_path(rows.sparkSession, path, F.col("file_id"))
        write_fixed_width(
            validated, summary, layout, output, by_block=by_block, mode=mode, source_name=name, whole_blocks=False
        )
    issues = malformed.select(*ISSUE_COLUMNS).unionByName(issue_table(validated, layout, parsed))
    return Conversion(validated, summary, issues, refused)


def refused_files(spark: SparkSession, path: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """Files that are not read at all: unknown type, empty, or too large."""
    return admit_files(list_files(spark, path), max_bytes).filter("problem is not null")


def convert_csv(
    spark: SparkSession, path: str | list[str], layout: Layout, output: str | None = None,
    delimiter: str | None = None, newline: str | None = None, charset: str = BIG5,
    max_bytes: int | None = None, mode: str = "errorifexists",
) -> Conversion:
    """Validate the CSV files below a path and write those without errors.

    With `output` None nothing is written. Files that cannot be used give issues and
    no output; the others are not held up by them.
    """
    source = read_csv(
        spark, path, layout.source_encoding, delimiter, newline, CSV_NAMES, max_bytes
    )
    parsed = source.files.filter("problem is null").select("file_id")
    return _convert(
        layout, source.rows, parsed, source.issues, refused_files(spark, path, max_bytes),
        charset, output, mode, path, source.by_block,
    )


def convert_xlsx(
    spark: SparkSession, path: str | list[str], layout: Layout, output: str | None = None,
    charset: str = BIG5, max_bytes: int | None = None, mode: str = "errorifexists",
) -> Conversion:
    """The same for workbooks: the displayed text of their first sheets."""
    source = read_xlsx(spark, path, len(layout.fields), max_bytes)
    parsed = source.rows.select("file_id").distinct()
    return _convert(
        layout, source.rows, parsed, source.issues, refused_files(spark, path, max_bytes),
        charset, output, mode, path,
    )


def convert_folder(
    spark: SparkSession, path: str | list[str], layout: Layout, output: str | None = None,
    delimiter: str | None = None, newline: str | None = None, charset: str = BIG5,
    max_bytes: int | None = None, mode: str = "errorifexists",
) -> Conversion:
    """CSV files and workbooks below a path together: one validation, one output, one set of reports.

    A file that cannot be used gives its issue and no output, whatever its kind.
    """
    lines = read_csv(spark, path, layout.source_encoding, delimiter, newline, CSV_NAMES, max_bytes)
    books = read_xlsx(spark, path, len(layout.fields), max_bytes)
    parts = F.floor((F.col("source_row") - 1) / ROWS_PER_PART).cast("bigint")
    rows = lines.rows.unionByName(books.rows.withColumn("block", parts))
    parsed = lines.files.filter("problem is null").select("file_id").unionByName(
        books.rows.select("file_id").distinct()
    )
    malformed = lines.issues.select(*ISSUE_COLUMNS).unionByName(books.issues.select(*ISSUE_COLUMNS))
    return _convert(
        layout, rows, parsed, malformed, refused_files(spark, path, max_bytes),
        charset, output, mode, path, lines.by_block,
    )


def error_files(conversion: Conversion) -> DataFrame:
    """Files that gave no output, with the number of their errors."""
    return (
        conversion.issues.filter(F.col("severity") == ERROR)
        .groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("error_count"))
    )

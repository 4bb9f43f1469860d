"""Issue table, counts, file summary, gate and preview: views of validated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bytelayout.functions import text
from bytelayout.layout import Layout
from bytelayout.operators.validate import ERROR, WARNING, with_field_results, with_record
from bytelayout.plans.joins import join_small

ISSUE_LIMIT = 200
ISSUE_COLUMNS = [
    "file_id", "source_row", "field_index", "seq", "severity", "code", "actual", "allowed", "message",
]

# Message templates by issue code.
MESSAGES = {
    "MISSING_REQUIRED": "Row {row}, field {field} must not be blank.",
    "INVALID_COLUMN_COUNT": "Row {row} has {actual} fields, expected {allowed}.",
    "INVALID_RECORD_COUNT": "The file has {actual} records, expected {allowed}.",
    "EMPTY_RECORD": "Row {row} is empty.",
    "WHITESPACE_ONLY_RECORD": "Row {row} holds only whitespace.",
    "WHITESPACE_ONLY_FIELD": "Row {row}, field {field} holds only whitespace.",
    "LEADING_WHITESPACE": "Row {row}, field {field} begins with whitespace.",
    "TRAILING_WHITESPACE": "Row {row}, field {field} ends with whitespace.",
    "NON_ASCII_WHITESPACE": "Row {row}, field {field} has whitespace other than plain spaces.",
    "UNSUPPORTED_CONTROL_CHARACTER": "Row {row}, field {field} has an unsupported control character.",
    "UNENCODABLE_BIG5": "Row {row}, field {field} has a character that Big5 lacks.",
    "WIDTH_OVERFLOW": "Row {row}, field {field} needs {actual} bytes, the width is {allowed}.",
}


def message(
    code: Column, row: Column, field: Column, actual: Column, allowed: Column,
    templates: dict[str, str] | None = None,
) -> Column:
    """Text of an issue; other wording or languages come in as `templates`."""
    values = {"{row}": row, "{field}": field, "{actual}": actual, "{allowed}": allowed}
    chosen: Column = F.lit(None).cast("string")
    for name, template in (templates or MESSAGES).items():
        used = sorted((mark for mark in values if mark in template), key=template.index)
        pattern = template.replace("%", "%%")
        for mark in used:
            pattern = pattern.replace(mark, "%d")
        filled = F.format_string(pattern, *[values[mark].cast("bigint") for mark in used])
        chosen = F.when(code == name, filled).otherwise(chosen)
    return chosen


def row_issues(validated: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per issue of a record or field."""
    # The outer form, since Spark would put a copy of the rules below the plain one.
    found = validated.select("file_id", "source_row", F.explode_outer("issues").alias("issue"))
    found = found.filter("issue is not null")
    return _with_message(found.select("file_id", "source_row", "issue.*"), templates)


def _with_message(issues: DataFrame, templates: dict[str, str] | None) -> DataFrame:
    return issues.withColumn(
        "message",
        message(
            F.col("code"), F.col("source_row"), F.col("field_index"),
            F.col("actual"), F.col("allowed"), templates,
        ),
    ).select(*ISSUE_COLUMNS)


def record_counts(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Records per file; a file listed in `files` counts even without any."""
    counts = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("actual_rows"))
    if files is None:
        return counts
    return files.select("file_id").join(counts, "file_id", "left").select(
        "file_id", F.coalesce("actual_rows", F.lit(0)).alias("actual_rows")
    )


def _with_expected(per_file: DataFrame, layout: Layout, expected: DataFrame | None) -> DataFrame:
    if expected is None:
        return per_file.withColumn("expected_rows", F.lit(layout.expected_rows).cast("bigint"))
    wanted = expected.select("file_id", F.col("expected_rows").cast("bigint").alias("expected_rows"))
    return per_file.join(wanted, "file_id", "left")


def count_issues(
    rows: DataFrame, layout: Layout, files: DataFrame | None = None,
    expected: DataFrame | None = None, templates: dict[str, str] | None = None,
) -> DataFrame:
    """INVALID_RECORD_COUNT of every file whose number of records is not the expected one."""
    counts = _with_expected(record_counts(rows, files), layout, expected)
    wrong = counts.filter(F.col("actual_rows") != F.col("expected_rows"))
    return _with_message(
        wrong.select(
            "file_id",
            F.lit(None).cast("bigint").alias("source_row"),
            F.lit(None).cast("int").alias("field_index"),
            F.lit(0).alias("seq"),
            F.lit(ERROR).alias("severity"),
            F.lit("INVALID_RECORD_COUNT").alias("code"),
            F.col("actual_rows").alias("actual"),
            F.col("expected_rows").alias("allowed"),
        ),
        templates,
    )


def issue_table(
    validated: DataFrame, layout: Layout, files: DataFrame | None = None,
    expected: DataFrame | None = None, templates: dict[str, str] | None = None,
) -> DataFrame:
    """All issues. (`source_row`, `field_index`, `seq`), NULLs first, is report order."""
    found = row_issues(validated, templates)
    if layout.expected_rows is None and expected is None:
        return found
    return count_issues(validated, layout, files, expected, templates).unionByName(found)


def in_report_order(issues: DataFrame) -> DataFrame:
    """Sort an issue table for reading. Writers and counts do not need it."""
    return issues.orderBy(
        "file_id", F.asc_nulls_first("source_row"), F.asc_nulls_first("field_index"), "seq"
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file_id", "severity", "code").agg(F.count(F.lit(1)).alias("issue_count"))


def cap_issues(issues: DataFrame, limit: int = ISSUE_LIMIT) -> DataFrame:
    """The first `limit` issues of each file and how many are not shown.

    The rank filter lets Spark keep at most `limit` rows per file and map task
    before the shuffle, so one file with most of the issues does no harm.
    """
    order = W.partitionBy("file_id").orderBy(
        F.asc_nulls_first("source_row"), F.asc_nulls_first("field_index"), "seq"
    )
    shown = issues.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    totals = issues.groupBy("file_id").agg(F.count(F.lit(1)).alias("_total"))
    return (
        shown.join(totals, "file_id")
        .withColumn("hidden_count", F.greatest(F.col("_total") - limit, F.lit(0)))
        .drop("_total")
    )


def summarize(
    validated: DataFrame, layout: Layout, files: DataFrame | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Counts, record width and output size per file, in one partial aggregation."""
    def how_many(severity: str) -> Column:
        return F.sum(F.size(F.filter("issues", lambda found: found["severity"] == severity)))

    per_file = validated.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("actual_rows"),
        F.count_if("valid").alias("valid_rows"),
        F.count_if(~F.col("valid")).alias("invalid_rows"),
        how_many(ERROR).alias("_row_errors"),
        how_many(WARNING).alias("warning_count"),
    )
    if files is not None:
        per_file = files.select("file_id").join(per_file, "file_id", "left").na.fill(0)
    per_file = _with_expected(per_file, layout, expected)
    wrong_count = F.coalesce(
        (F.col("actual_rows") != F.col("expected_rows")).cast("bigint"), F.lit(0)
    )
    width = layout.record_width
    return per_file.withColumn("error_count", F.col("_row_errors") + wrong_count).select(
        "file_id", "actual_rows", "valid_rows", "invalid_rows", "error_count", "warning_count",
        F.lit(width).alias("record_width_bytes"),
        F.when(F.col("error_count") == 0, F.col("actual_rows") * (width + 2)).alias("output_size"),
    )


def gate(validated: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows of the files without any error; a file with one error gives no rows."""
    passed = summary.filter(F.col("error_count") == 0).select("file_id")
    return join_small(validated, passed, ["file_id"], "left_semi", spread_by=F.col("source_row"))


def preview(
    validated: DataFrame, layout: Layout, limit: int | None = 20, marks: bool = True
) -> DataFrame:
    """The first valid records of each file as shown text, all of them for `None`."""
    valid = validated.filter("valid")
    if limit is not None:
        order = W.partitionBy("file_id").orderBy("source_row")
        valid = (
            valid.withColumn("_rank", F.row_number().over(order))
            .filter(F.col("_rank") <= limit)
            .drop("_rank")
        )
    shown = F.array_join(
        F.transform(
            "field_results",
            lambda field: text.preview_field(
                field["resolved_value"], field["padding_bytes"], layout.alignment, marks
            ),
        ),
        "",
    )
    return with_field_results(valid, layout).select("file_id", "source_row", shown.alias("preview"))


def records(validated: DataFrame, layout: Layout, line_end: bool = True) -> DataFrame:
    """Bytes of the valid rows. Apply `gate` first when whole files are written."""
    return with_record(validated, layout, line_end).filter("valid").drop(
        "fields", "resolved", "encoded", "issues", "valid"
    )

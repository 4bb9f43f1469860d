"""Spreadsheet cells as records.

A `cells` table has one row per populated cell: `file_id`, `sheet_index`,
`sheet_name`, `r` and `c` from 0, `type` (s, n, b, e), `v` value, `w` stored text,
`f` formula, `z` number format. It comes from `xlsx.read_cells` or from elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelayout.functions.render import cell_text
from bytelayout.operators.validate import ERROR
from bytelayout.plans.joins import join_small

MALFORMED = "MALFORMED_SPREADSHEET"
MAX_ROWS = 100_000
MAX_COLUMNS = 1_024

CELLS_SCHEMA = (
    "file_id string, sheet_index int, sheet_name string, r int, c int, "
    "type string, v string, w string, f string, z string"
)

# Problem texts.
NO_FORMULA_RESULT = "the formula has no saved result"
UNKNOWN_FORMAT = "the number format is not supported"
NO_NUMBER = "the value is not a number"
TOO_FAR = "the sheet reaches beyond the supported rows or columns"
EMPTY_SHEET = "the first sheet has no data"


@dataclass(frozen=True)
class SheetSource:
    rows: DataFrame
    issues: DataFrame


def populated(cells: DataFrame) -> DataFrame:
    """Cells of the first sheet with a value or a formula."""
    return cells.filter(
        (F.col("sheet_index") == 0) & (F.col("v").isNotNull() | F.col("f").isNotNull())
    )


def column_letters(c: Column) -> Column:
    """A, B, ... Z, AA, ... for a column number from 0."""
    letter = lambda n: F.char(F.lit(65) + F.pmod(n, F.lit(26)))
    one = letter(c)
    two = F.concat(letter(F.floor(c / 26) - 1), one)
    three = F.concat(letter(F.floor((c - 26) / 676) - 1), letter(F.floor((c - 26) / 26)), one)
    return F.when(c < 26, one).when(c < 702, two).otherwise(three)


def cell_address(r: Column, c: Column) -> Column:
    return F.concat(column_letters(c), (r + 1).cast("string"))


def sheet_extents(cells: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Last row and column of each first sheet, and whether they are within bounds."""
    return populated(cells).groupBy("file_id").agg(
        F.max("r").alias("last_row"),
        F.max("c").alias("last_column"),
        ((F.max("r") >= max_rows) | (F.max("c") >= max_columns)).alias("too_far"),
    )


def dense_rows(cells: DataFrame, min_columns: int = 1) -> DataFrame:
    """Records of sparse sheets: all rows from the first to the last populated one.

    Each is as wide as its last cell needs, `min_columns` at least; gaps are empty
    values. Rows are grouped by (file, row), so a large file is many small groups.
    """
    shown = populated(cells).select(
        "file_id", "r", "c",
        F.coalesce(cell_text(F.col("type"), F.col("v"), F.col("w"), F.col("z")), F.lit("")).alias("text"),
    )
    # A cell given twice counts once, with its largest text.
    shown = shown.groupBy("file_id", "r", "c").agg(F.max("text").alias("text"))
    by_row = shown.groupBy("file_id", "r").agg(
        F.array_sort(F.collect_list(F.struct("c", "text"))).alias("_cells"),
        F.max("c").alias("_last"),
    )
    width = F.greatest(F.col("_last") + 1, F.lit(min_columns))
    by_column = F.map_from_entries("_cells")
    wide = by_row.select(
        "file_id", "r",
        # A row without gaps, the usual case, needs no lookup by column.
        F.when(F.size("_cells") == width, F.transform("_cells", lambda cell: cell["text"]))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), width - 1),
                lambda at: F.coalesce(F.try_element_at(by_column, at), F.lit("")),
            )
        )
        .alias("fields"),
    )
    spine = (
        populated(cells)
        .groupBy("file_id")
        .agg(F.max("r").alias("_last_row"))
        .select("file_id", F.explode(F.sequence(F.lit(0), "_last_row")).alias("r"))
    )
    blank = F.array_repeat(F.lit(""), min_columns)
    return spine.join(wide, ["file_id", "r"], "left").select(
        "file_id",
        (F.col("r") + 1).cast("bigint").alias("source_row"),
        F.coalesce("fields", blank).alias("fields"),
    )


def sheet_issue(problem: Column, source_row: Column | None = None, field: Column | None = None) -> list[Column]:
    row = F.lit(None) if source_row is None else source_row
    column = F.lit(None) if field is None else field
    return [
        F.col("file_id"),
        row.cast("bigint").alias("source_row"),
        column.cast("int").alias("field_index"),
        F.lit(0).alias("seq"),
        F.lit(ERROR).alias("severity"),
        F.lit(MALFORMED).alias("code"),
        F.lit(None).cast("bigint").alias("actual"),
        F.lit(None).cast("bigint").alias("allowed"),
        F.concat(F.lit("Malformed spreadsheet. "), problem, F.lit(".")).alias("message"),
    ]


def cell_issues(cells: DataFrame) -> DataFrame:
    """Formulas without a saved result, and number formats that cannot be shown."""
    shown = populated(cells).withColumn(
        "_text", cell_text(F.col("type"), F.col("v"), F.col("w"), F.col("z"))
    )
    problem = (
        F.when(F.col("v").isNull(), NO_FORMULA_RESULT)
        .when((F.col("type") == "n") & F.col("w").isNull() & F.col("v").try_cast("double").isNull(), NO_NUMBER)
        .when(F.col("_text").isNull(), UNKNOWN_FORMAT)
    )
    named = F.concat(
        F.lit("Cell "), cell_address(F.col("r"), F.col("c")), F.lit(": "), F.col("_problem")
    )
    return shown.withColumn("_problem", problem).filter("_problem is not null").select(
        *sheet_issue(named, F.col("r") + 1, F.col("c") + 1)
    )


def extent_issues(extents: DataFrame) -> DataFrame:
    return extents.filter("too_far").select(*sheet_issue(F.lit(TOO_FAR)))


def sheet_rows(
    cells: DataFrame, min_columns: int, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS
) -> SheetSource:
    """Records of the sheets that can be used, and issues of the others."""
    extents = sheet_extents(cells, max_rows, max_columns)
    within = extents.filter("not too_far").select("file_id")
    checked = join_small(cells, within, ["file_id"], "left_semi", spread_by=F.col("r"))
    issues = extent_issues(extents).unionByName(cell_issues(checked))
    failed = issues.select("file_id").distinct()
    usable = join_small(checked, failed, ["file_id"], "left_anti", spread_by=F.col("r"))
    return SheetSource(dense_rows(usable, min_columns), issues)

"""Cells of `.xlsx` workbooks, one workbook per input row."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelayout.functions.render import DATE_PATTERNS
from bytelayout.plans.joins import join_small
from bytelayout.session import staged
from bytelayout.sources.cells import (
    CELLS_SCHEMA, EMPTY_SHEET, MAX_COLUMNS, MAX_ROWS, SheetSource, sheet_issue, sheet_rows,
)
from bytelayout.sources.files import admit_files, file_options, file_type, list_files

OUTPUT_SCHEMA = CELLS_SCHEMA + ", problem string"
UNREADABLE = "the workbook cannot be read"
NO_SHEET = "the workbook has no sheet"
WORKBOOKS = "*.[xX][lL][sS]*"
CELLS_PER_FRAME = 50_000
LEGACY = "the legacy .xls format is not supported"

# Fixed value: days between the origins of the two date systems.
DAYS_TO_1904 = 1462

# Number format ids every workbook knows without declaring them.
BUILT_IN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 9: "0%", 10: "0.00%", 14: "m/d/yy", 49: "@",
}


def _texts(element: ElementTree.Element) -> str:
    """Text of a string item; phonetic hints are not part of it."""
    return "".join(
        text.text or ""
        for child in element
        if not child.tag.endswith("}rPh")
        for text in child.iter()
        if text.tag.endswith("}t")
    )


def _find(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (element for element in root.iter() if element.tag.endswith("}" + name))


def _number_formats(archive: zipfile.ZipFile, names: set[str]) -> list[str]:
    if "xl/styles.xml" not in names:
        return []
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    known = dict(BUILT_IN_FORMATS)
    for item in _find(root, "numFmt"):
        known[int(item.get("numFmtId", "0"))] = item.get("formatCode", "General")
    for formats in _find(root, "cellXfs"):
        return [known.get(int(item.get("numFmtId", "0")), item.get("numFmtId", "")) for item in formats]
    return []


def _counts_from_1904(workbook: ElementTree.Element) -> bool:
    return any(item.get("date1904") in ("1", "true") for item in _find(workbook, "workbookPr"))


def _since_1900(value: str, number_format: str) -> str:
    """A day number of the 1904 system as one of the 1900 system, if it is shown as a date."""
    if number_format not in DATE_PATTERNS:
        return value
    try:
        return repr(float(value) + DAYS_TO_1904)
    except ValueError:
        return value


def _first_sheet(archive: zipfile.ZipFile, workbook: ElementTree.Element) -> tuple[str, str] | None:
    sheet = next(_find(workbook, "sheet"), None)
    if sheet is None:
        return None
    wanted = next((value for key, value in sheet.items() if key.endswith("}id")), None)
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    for link in _find(links, "Relationship"):
        if link.get("Id") == wanted:
            target = link.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
            return sheet.get("name", ""), path
    return None


def _position(address: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", address).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    return int(digits) - 1, column - 1


def _shared_strings(archive: zipfile.ZipFile, names: set[str]) -> list[str]:
    """Texts that cells refer to by number. Items are let go as soon as they are read."""
    if "xl/sharedStrings.xml" not in names:
        return []
    texts: list[str] = []
    with archive.open("xl/sharedStrings.xml") as stream:
        parser = ElementTree.iterparse(stream, ("start", "end"))
        _, root = next(parser)
        for event, element in parser:
            if event == "end" and element.tag.endswith("}si"):
                texts.append(_texts(element))
                root.clear()
    return texts


def _cell_elements(stream: io.BufferedIOBase) -> Iterator[ElementTree.Element]:
    """Cells of a sheet in the order of the file; a row is let go when it ends."""
    rows = None
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            if element.tag.endswith("}sheetData"):
                rows = element
        elif element.tag.endswith("}c"):
            yield element
            element.clear()
        elif element.tag.endswith("}row") and rows is not None:
            rows.clear()


def workbook_cells(
    content: bytes, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS
) -> Iterator[tuple]:
    """Populated cells (sheet name, r, c, type, v, w, f, z) of a workbook's first sheet, as they are read.

    Reading ends with the first cell beyond the supported rows or columns; that cell
    is given, so that the sheet can be judged by its cells. Damage raises where it is met.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        workbook = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        found, from_1904 = _first_sheet(archive, workbook), _counts_from_1904(workbook)
        if found is None:
            raise LookupError(NO_SHEET)
        sheet_name, path = found
        shared, formats = _shared_strings(archive, names), _number_formats(archive, names)
        with archive.open(path) as stream:
            for element in _cell_elements(stream):
                parts = {child.tag.rsplit("}", 1)[1]: child for child in element}
                value = parts["v"].text if "v" in parts else None
                formula = (parts["f"].text or "") if "f" in parts else None
                kind = element.get("t", "n")
                if kind == "inlineStr" and "is" in parts:
                    value = _texts(parts["is"])
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "str" and "v" in parts:
                    value = value or ""
                style = int(element.get("s", "0"))
                number_format = formats[style] if style < len(formats) else "General"
                kind = {"inlineStr": "s", "str": "s", "d": "s"}.get(kind, kind)
                if from_1904 and kind == "n" and value is not None:
                    value = _since_1900(value, number_format)
                if value is not None or formula is not None:
                    row, column = _position(element.get("r"))
                    yield sheet_name, row, column, kind, value, None, formula, number_format
                    if row >= max_rows or column >= max_columns:
                        return


def _extract(
    batches: Iterator[pd.DataFrame], max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS
) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in OUTPUT_SCHEMA.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"sheet_index": "Int32", "r": "Int32", "c": "Int32"})

    for batch in batches:
        for file_id, content in zip(batch["file_id"], batch["content"]):
            problem, rows, any_cell = None, [], False
            try:
                for cell in workbook_cells(bytes(content), max_rows, max_columns):
                    rows.append((file_id, 0, *cell, None))
                    any_cell = True
                    if len(rows) == CELLS_PER_FRAME:
                        yield frame(rows)
                        rows = []
            except LookupError as error:
                problem = NO_SHEET if str(error.args[0]) == NO_SHEET else UNREADABLE
            except Exception:  # any damage to the archive or its XML
                problem = UNREADABLE
            if problem is None and not any_cell:
                problem = EMPTY_SHEET
            yield frame([(file_id, *[None] * 9, problem)] if problem else rows)


def extract_cells(
    books: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """Cells of workbooks given as `file_id` and `content`, and a row with `problem` for bad ones.

    Sheets are read as streams, in frames of `CELLS_PER_FRAME` cells, so cells read
    before damage was met may come beside the `problem` of their file.
    """
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _extract(batches, max_rows, max_columns)

    return books.select("file_id", "content").mapInPandas(extract, OUTPUT_SCHEMA)


def read_cells(
    spark: SparkSession, path: str | list[str], max_bytes: int | None = None,
    max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """Cells of all workbooks below a path; `.xls` and refused files only get a `problem`."""
    found = spark.read.format("binaryFile").options(**file_options(WORKBOOKS)).load(path)
    listed = admit_files(list_files(spark, path, WORKBOOKS), max_bytes)
    listed = listed.withColumn(
        "problem",
        F.coalesce("problem", F.when(F.col("file_type") == "xls", LEGACY)),
    )
    problems = listed.filter("problem is not null and file_type is not null")
    # Refused workbooks are left out before their content is read.
    kept = found.filter(file_type(F.col("_metadata.file_name")) == "xlsx")
    if max_bytes is not None:
        kept = kept.filter(F.col("_metadata.file_size") <= max_bytes)
    cells = extract_cells(kept.select(F.col("_metadata.file_path").alias("file_id"), "content"), max_rows, max_columns)
    empty = [F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in CELLS_SCHEMA.split(", ")[1:]]
    return cells.unionByName(problems.select("file_id", *empty, "problem"))


def read_xlsx(
    spark: SparkSession, path: str | list[str], min_columns: int, max_bytes: int | None = None,
    max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS,
) -> SheetSource:
    """Records of the first sheets of `.xlsx` files, by their displayed text.

    Workbooks are read once, into the shared folder. A file whose damage is met late
    gives its issue and no rows.
    """
    found = staged(read_cells(spark, path, max_bytes, max_rows, max_columns), "cells")
    failed = found.filter("problem is not null")
    cells = join_small(
        found.filter("problem is null").drop("problem"), failed.select("file_id"), ["file_id"], "left_anti",
        spread_by=F.col("r"),
    )
    source = sheet_rows(cells, min_columns, max_rows, max_columns)
    return SheetSource(source.rows, failed.select(*sheet_issue(F.col("problem"))).unionByName(source.issues))

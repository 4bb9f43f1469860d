"""Layouts as tables: running widths, differences, settings documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bytelayout.layout import (
    COLUMN_SHAPE, DOCUMENT_SHAPE, FLAG, INTEGER, LIST, MAX_SETTINGS_BYTES, TEXT, VERSION, Shape,
)

COLUMN_TYPE = "array<struct<required:boolean,defaultValue:string,widthBytes:bigint>>"


def running_widths(layouts: DataFrame) -> DataFrame:
    """Add start and end position of each field and the total width of its layout.

    From the first field whose width is not a positive number on, positions are
    NULL, and so is the total.
    """
    order = W.partitionBy("layout_id").orderBy("field_index")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    good = F.coalesce(F.col("width_bytes") >= 1, F.lit(False))
    end = F.when(F.min(good).over(so_far), F.sum("width_bytes").over(so_far))
    return (
        layouts.withColumn("end_byte", end)
        .withColumn("start_byte", F.col("end_byte") - F.col("width_bytes") + 1)
        .withColumn(
            "record_width_bytes", F.when(F.min(good).over(whole), F.sum("width_bytes").over(whole))
        )
    )


def layout_diff(layouts: DataFrame, reference: DataFrame) -> DataFrame:
    """Fields in which a layout differs from the reference layout of the same id.

    Gives one row per differing field with the names of the differing properties;
    a field that only one side has differs in `presence`.
    """
    properties = ["required", "default_value", "width_bytes"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("layout_id", "field_index", F.struct(*properties).alias(name))

    both = side(layouts, "left").join(side(reference, "right"), ["layout_id", "field_index"], "full")
    missing = F.col("left").isNull() | F.col("right").isNull()
    changed = F.when(missing, F.array(F.lit("presence"))).otherwise(
        F.array_compact(
            F.array(
                *[
                    F.when(~F.col(f"left.{name}").eqNullSafe(F.col(f"right.{name}")), name)
                    for name in properties
                ]
            )
        )
    )
    return both.select("layout_id", "field_index", changed.alias("differs")).filter(
        F.size("differs") > 0
    )


def _is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _is_number(value: Column) -> Column:
    numeric = F.schema_of_variant(value).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(numeric & (number > 0) & (number == F.floor(number)), F.lit(False))


def _is_filled(value: Column) -> Column:
    return _is_kind(value, "ARRAY") & F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")) > 0, F.lit(False))


_FITS = {
    INTEGER: _is_number,
    TEXT: lambda value: _is_kind(value, "STRING"),
    FLAG: lambda value: _is_kind(value, "BOOLEAN"),
    LIST: _is_filled,
}


def _fits(value: Column, shape: Shape) -> Column:
    """Whether a variant is an object with all properties of a shape."""
    result = _is_kind(value, "OBJECT")
    for name, (kind, allowed) in shape.items():
        found = F.try_variant_get(value, f"$.{name}", "variant")
        result = result & _FITS[kind](found)
        if allowed is not None:
            plain = F.try_variant_get(found, "$", "string" if kind == TEXT else "double")
            result = result & F.coalesce(plain.isin(*allowed), F.lit(False))
    return result


def parse_settings(documents: DataFrame, settings: str = "settings") -> DataFrame:
    """Parse and check a column of settings documents.

    Adds `settings_ok` and, for usable documents, `source_encoding`, `alignment`,
    `expected_rows` and `columns`; the default of a required field is cleared.
    The checks look at the JSON types themselves, so `"2"` is not taken for 2.
    """
    text = F.col(settings)
    parsed = documents.withColumn(
        "_doc", F.when(F.octet_length(text).between(1, MAX_SETTINGS_BYTES), F.try_parse_json(text))
    )

    def part(name: str, kind: str = "variant") -> Column:
        return F.try_variant_get("_doc", f"$.{name}", kind)

    def inner(column: Column, name: str, kind: str = "variant") -> Column:
        return F.try_variant_get(column, f"$.{name}", kind)

    columns = part("columns", "array<variant>")
    ok = _fits(F.col("_doc"), DOCUMENT_SHAPE) & F.forall(columns, lambda column: _fits(column, COLUMN_SHAPE))
    layout = F.transform(
        columns,
        lambda column: F.struct(
            inner(column, "required", "boolean").alias("required"),
            F.when(inner(column, "required", "boolean"), "")
            .otherwise(inner(column, "defaultValue", "string"))
            .alias("defaultValue"),
            inner(column, "widthBytes", "double").cast("bigint").alias("widthBytes"),
        ),
    ).cast(COLUMN_TYPE)
    return (
        parsed.withColumn("settings_ok", F.coalesce(ok, F.lit(False)))
        .withColumn("source_encoding", F.when(F.col("settings_ok"), part("sourceEncoding", "string")))
        .withColumn("alignment", F.when(F.col("settings_ok"), part("alignment", "string")))
        .withColumn(
            "expected_rows", F.when(F.col("settings_ok"), part("expectedRows", "double").cast("bigint"))
        )
        .withColumn("columns", F.when(F.col("settings_ok"), layout))
        .drop("_doc")
    )


def settings_diff(parsed: DataFrame, reference: DataFrame) -> DataFrame:
    """Properties in which parsed settings differ from the reference settings of the same id.

    Besides `source_encoding`, `alignment` and `expected_rows`, `columns` is named when the
    fields differ in number, flags, defaults or widths (`layout_diff` tells in which); ids
    that only one side has differ in `presence`.
    """
    properties = ["source_encoding", "alignment", "expected_rows", "columns"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.filter("settings_ok").select("layout_id", F.struct(*properties).alias(name))

    both = side(parsed, "left").join(side(reference, "right"), "layout_id", "full")
    changed = [F.when(~F.col(f"left.{name}").eqNullSafe(F.col(f"right.{name}")), name) for name in properties]
    missing = F.col("left").isNull() | F.col("right").isNull()
    differs = F.when(missing, F.array(F.lit("presence"))).otherwise(F.array_compact(F.array(*changed)))
    return both.select("layout_id", differs.alias("differs")).filter(F.size("differs") > 0)


def settings_fields(parsed: DataFrame, layout_id: str = "layout_id") -> DataFrame:
    """The layout table of parsed settings documents, one row per field."""
    return parsed.filter("settings_ok").select(
        F.col(layout_id).alias("layout_id"), F.posexplode("columns").alias("_at", "_column")
    ).select(
        "layout_id",
        (F.col("_at") + 1).alias("field_index"),
        F.col("_column.required").alias("required"),
        F.col("_column.defaultValue").alias("default_value"),
        F.col("_column.widthBytes").alias("width_bytes"),
    )


def settings_json(
    layouts: DataFrame, source_encoding: str = "auto", alignment: str = "left",
    expected_rows: Column | int = 200,
) -> DataFrame:
    """Write layout tables as settings documents, one per layout."""
    column = F.struct(
        F.col("required"),
        F.col("default_value").alias("defaultValue"),
        F.col("width_bytes").alias("widthBytes"),
    )
    columns = F.transform(
        F.array_sort(F.collect_list(F.struct("field_index", column.alias("column")))),
        lambda entry: entry["column"],
    )
    expected = F.lit(expected_rows) if isinstance(expected_rows, int) else expected_rows
    return (
        layouts.groupBy("layout_id")
        .agg(columns.alias("columns"))
        .select(
            "layout_id",
            F.to_json(
                F.struct(
                    F.lit(VERSION).alias("version"),
                    F.lit(source_encoding).alias("sourceEncoding"),
                    F.lit(alignment).alias("alignment"),
                    expected.alias("expectedRows"),
                    F.col("columns"),
                )
            ).alias("settings"),
        )
    )

"""Row and field rules of a fixed-width layout.

`validate` is one lazy projection without a shuffle. Arrays keep the plan the
same size for any number of fields, and every field first meets one cheap test
that most values pass; the single rules run only for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelayout.functions import text
from bytelayout.functions.charset import BIG5, encode_big5
from bytelayout.layout import Layout
from bytelayout.session import charset_flags

ERROR = "error"
WARNING = "warning"
ISSUE_TYPE = (
    "struct<seq:int,severity:string,code:string,field_index:int,actual:bigint,allowed:bigint>"
)
CRLF = b"\r\n"


def issue(
    seq: int,
    severity: str,
    code: Column | str,
    field_index: Column | None = None,
    actual: Column | None = None,
    allowed: Column | None = None,
) -> Column:
    nothing = F.lit(None)
    return F.struct(
        F.lit(seq).alias("seq"),
        F.lit(severity).alias("severity"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        (nothing if field_index is None else field_index).cast("int").alias("field_index"),
        (nothing if actual is None else actual).cast("bigint").alias("actual"),
        (nothing if allowed is None else allowed).cast("bigint").alias("allowed"),
    ).cast(ISSUE_TYPE)


def record_problem(fields: Column) -> Column:
    """EMPTY_RECORD, WHITESPACE_ONLY_RECORD or NULL."""
    return (
        F.when(F.exists(fields, text.has_text), F.lit(None))
        .when(F.forall(fields, lambda v: v == ""), "EMPTY_RECORD")
        .otherwise("WHITESPACE_ONLY_RECORD")
    )


def resolve_defaults(fields: Column, layout: Layout) -> Column:
    """Values after defaults: only an exactly empty value takes its default."""
    if not any(field.default_value for field in layout.fields):
        return fields
    defaults = F.array(*[F.lit(field.default_value) for field in layout.fields])
    return F.zip_with(fields, defaults, lambda v, d: F.when(v == "", d).otherwise(v))


def blocking_issue(
    value: Column, data: Column, required: Column, width: Column, field_index: Column
) -> Column:
    """The first rule that keeps a field out of the output, or NULL."""
    size = F.octet_length(data)
    return (
        F.when(required & ~text.has_text(value), issue(7, ERROR, "MISSING_REQUIRED", field_index))
        .when(text.has_control(value), issue(7, ERROR, "UNSUPPORTED_CONTROL_CHARACTER", field_index))
        .when(data.isNull(), issue(7, ERROR, "UNENCODABLE_BIG5", field_index))
        .when(size > width, issue(7, ERROR, "WIDTH_OVERFLOW", field_index, size, width))
    )


def field_issues(
    value: Column, data: Column, required: Column, width: Column, field_index: Column
) -> Column:
    """Issues of one field in report order, NULL when there are none."""
    fits = F.coalesce(F.octet_length(data) <= width, F.lit(False))
    quiet = text.is_calm(value) & fits & ~(required & (value == ""))
    found = F.array_compact(
        F.array(
            F.when(
                text.has_leading_whitespace(value),
                issue(3, WARNING, "LEADING_WHITESPACE", field_index),
            ),
            F.when(
                text.has_trailing_whitespace(value),
                issue(4, WARNING, "TRAILING_WHITESPACE", field_index),
            ),
            F.when(
                text.has_other_whitespace(value),
                issue(5, WARNING, "NON_ASCII_WHITESPACE", field_index),
            ),
            F.when(
                (value != "") & ~text.has_text(value),
                issue(6, WARNING, "WHITESPACE_ONLY_FIELD", field_index),
            ),
            blocking_issue(value, data, required, width, field_index),
        )
    )
    return F.when(~quiet, found)


def is_quiet(widths: Column, required: Column | None) -> Column:
    """A record none of whose fields can have an issue: most records, found cheaply."""
    def yes(test: Column) -> Column:
        return test

    fits = F.zip_with(
        "encoded", widths, lambda data, width: F.coalesce(F.octet_length(data) <= width, F.lit(False))
    )
    quiet = F.forall("resolved", text.is_calm) & F.forall(fits, yes)
    if required is None:
        return quiet
    present = F.zip_with("resolved", required, lambda value, needed: ~needed | (value != ""))
    return quiet & F.forall(present, yes)


def validate(rows: DataFrame, layout: Layout, charset: str = BIG5) -> DataFrame:
    """Check every record against the layout.

    `rows` has `file_id`, `source_row` and `fields`; other columns pass through.
    Adds `resolved` (values after defaults), `encoded` (their bytes, NULL where
    the charset has none), `issues` and `valid`. The first two are NULL for
    records whose shape already fails.
    """
    count = len(layout.fields)
    widths = F.array(*[F.lit(field.width_bytes) for field in layout.fields])
    flags = F.array(*[F.lit(field.required) for field in layout.fields])
    any_required = any(field.required for field in layout.fields)

    def of_field(data: Column, position: Column) -> Column:
        required = F.get(flags, position) if any_required else F.lit(False)
        return field_issues(
            F.get(F.col("resolved"), position), data, required, F.get(widths, position), position + 1
        )

    with charset_flags(rows.sparkSession):
        shaped = rows.withColumn("_problem", record_problem(F.col("fields")))
        resolved = shaped.withColumn(
            "resolved",
            F.when(
                F.col("_problem").isNull() & (F.size("fields") == count),
                resolve_defaults(F.col("fields"), layout),
            ),
        )
        encoded = resolved.withColumn(
            "encoded", F.transform("resolved", lambda v: encode_big5(v, charset))
        )
        of_record = F.array_compact(
            F.array(
                F.when(F.col("_problem").isNotNull(), issue(1, ERROR, F.col("_problem"))),
                F.when(
                    F.size("fields") != count,
                    issue(
                        2, ERROR, "INVALID_COLUMN_COUNT", None, F.size("fields"), F.lit(count)
                    ),
                ),
            )
        )
        of_fields = F.flatten(F.array_compact(F.transform("encoded", of_field)))
        checked = encoded.withColumn(
            "issues",
            F.when(F.col("resolved").isNull(), of_record)
            .when(is_quiet(widths, flags if any_required else None), F.array().cast(f"array<{ISSUE_TYPE}>"))
            .otherwise(of_fields),
        )
        return _computed_once(checked.drop("_problem"))


def _computed_once(checked: DataFrame) -> DataFrame:
    """Add `valid`, and keep filters on it or on `issues` from copying the rules.

    Spark moves a filter below the projections it refers to and copies their
    expressions into it, here all the rules of a record. It does not move one below
    a generator, so both columns pass through one that gives a single row.
    """
    valid = ~F.exists("issues", lambda found: found["severity"] == ERROR)
    verdict = F.explode_outer(F.array(F.struct("issues", "valid")))
    others = [name for name in checked.columns if name != "issues"]
    judged = checked.withColumn("valid", valid)
    return judged.select(*others, verdict.alias("_verdict")).select(
        *others, F.col("_verdict.issues").alias("issues"), F.col("_verdict.valid").alias("valid")
    )


def pad_field(data: Column, width: int, alignment: str = "left") -> Column:
    """Bytes padded with ASCII spaces to the width. Never call it on wider bytes."""
    pad = F.rpad if alignment == "left" else F.lpad
    return pad(data, F.lit(width), F.lit(b" "))


def with_record(validated: DataFrame, layout: Layout, line_end: bool = True) -> DataFrame:
    """Add `record`: the fixed-width bytes of a valid row, NULL for the others."""
    parts = [
        pad_field(F.get(F.col("encoded"), F.lit(position)), field.width_bytes, layout.alignment)
        for position, field in enumerate(layout.fields)
    ]
    if line_end:
        parts.append(F.lit(CRLF))
    return validated.withColumn("record", F.when(F.col("valid"), F.concat(*parts)))


def with_field_results(validated: DataFrame, layout: Layout) -> DataFrame:
    """Add `field_results`: what became of every field of a record."""
    widths = F.array(*[F.lit(field.width_bytes) for field in layout.fields])

    def result(data: Column, position: Column) -> Column:
        source = F.get(F.col("fields"), position)
        value = F.get(F.col("resolved"), position)
        width = F.get(widths, position)
        refused = F.exists(
            "issues",
            lambda found: (found["field_index"] == position + 1)
            & found["code"].isin("MISSING_REQUIRED", "UNSUPPORTED_CONTROL_CHARACTER"),
        )
        size = F.when(refused, 0).otherwise(F.coalesce(F.octet_length(data), F.lit(0)))
        measured = ~refused & data.isNotNull()
        return F.struct(
            (position + 1).alias("field_index"),
            source.alias("source_value"),
            value.alias("resolved_value"),
            ((source == "") & (value != "")).alias("used_default"),
            size.alias("value_bytes"),
            F.when(measured & (size <= width), width - size).otherwise(0).alias("padding_bytes"),
        )

    return validated.withColumn(
        "field_results", F.coalesce(F.transform("encoded", result), F.array())
    )

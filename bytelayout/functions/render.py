"""Display text of typed values: what a spreadsheet shows for a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERAL = "General"
# The number formats that are understood, with the pattern of the
# dates among them. The locale-bound built-in date shows as year/month/day.
NUMBER_DECIMALS = {"0": 0, "0.0": 1, "0.00": 2, "0.000": 3}
PERCENT_DECIMALS = {"0%": 0, "0.0%": 1, "0.00%": 2}
DATE_PATTERNS = {
    "yyyy-mm-dd": "yyyy-MM-dd",
    "yyyy/mm/dd": "yyyy/MM/dd",
    "yyyymmdd": "yyyyMMdd",
    "m/d/yy": "yyyy/MM/dd",
}
FORMATS = (GENERAL, "@", *NUMBER_DECIMALS, *PERCENT_DECIMALS, *DATE_PATTERNS)

SERIAL_ORIGIN = "1899-12-30"
LOST_LEAP_DAY = 60


def boolean_text(value: Column) -> Column:
    return F.when(value, "TRUE").when(~value, "FALSE")


def general_text(number: Column) -> Column:
    """A number in the General format: at most ten digits, no trailing zeros."""
    size = F.abs(number)
    digits = F.floor(F.log10(size)) + 1
    decimals = F.when(size < 1, 9).otherwise(F.greatest(F.lit(10) - digits, F.lit(0)))
    factor = F.pow(F.lit(10.0), decimals)
    shortened = (F.round(number * factor) / factor).cast("decimal(24,10)").cast("string")
    fixed = F.regexp_replace(shortened, "\\.?0+\\z", "")
    mantissa = F.regexp_replace(F.format_string("%.5E", number), "\\.?0+E", "E")
    return (
        F.when(number == 0, "0")
        .when((number == F.floor(number)) & (size < 1e11), number.cast("bigint").cast("string"))
        .when((size >= 1e-4) & (size < 1e11), fixed)
        .otherwise(mantissa)
    )


def serial_date(number: Column) -> Column:
    """Date of a spreadsheet day number, with its imaginary 29 February 1900."""
    day = F.floor(number).cast("int")
    return F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.when(day < LOST_LEAP_DAY, day + 1).otherwise(day))


def number_text(number: Column, number_format: str) -> Column:
    """A double shown by one of the known formats."""
    if number_format in NUMBER_DECIMALS:
        return F.format_string(f"%.{NUMBER_DECIMALS[number_format]}f", number)
    if number_format in PERCENT_DECIMALS:
        return F.format_string(f"%.{PERCENT_DECIMALS[number_format]}f%%", number * 100)
    if number_format in DATE_PATTERNS:
        return F.date_format(serial_date(number), DATE_PATTERNS[number_format])
    if number_format in (GENERAL, "@"):
        return general_text(number)
    raise ValueError(f"number format {number_format!r} is not supported")


def cell_text(kind: Column, value: Column, stored: Column, number_format: Column) -> Column:
    """Display text of a cell: the stored text, else the value by type and format.

    `kind` is s (text), n (number), b (boolean) or e (error text). NULL means that
    a number has a format which is not supported, or is no number.
    """
    number = value.try_cast("double")
    shown: Column = F.lit(None).cast("string")
    wanted = F.coalesce(number_format, F.lit(GENERAL))
    for name in FORMATS:
        shown = F.when(wanted == name, number_text(number, name)).otherwise(shown)
    return (
        F.when(stored.isNotNull(), stored)
        .when(value.isNull(), "")
        .when(kind == "b", boolean_text(value.isin("1", "true", "TRUE")))
        .when(kind == "n", shown)
        .otherwise(value)
    )


def typed_text(value: Column, data_type: str, number_format: str | None) -> Column:
    """Text of a typed DataFrame column by an explicit format; never by a silent cast."""
    if data_type == "string":
        return value
    if data_type == "boolean":
        return boolean_text(value)
    if number_format is None:
        if data_type in ("tinyint", "smallint", "int", "bigint"):
            return value.cast("string")
        raise TypeError(f"a {data_type} column needs a format")
    if data_type in ("date", "timestamp", "timestamp_ntz"):
        if number_format not in DATE_PATTERNS:
            raise ValueError(f"date format {number_format!r} is not supported")
        return F.date_format(value, DATE_PATTERNS[number_format])
    if number_format == "0" and data_type in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("string")
    return number_text(value.cast("double"), number_format)

"""Whitespace and control character tests, visible marks, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace, spelled out because
# regex dialects disagree (U+0085 and U+200B are not whitespace here).
WHITESPACE_BUT_SPACE = (
    "\\t\\n\\x0B\\f\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
)
WHITESPACE = " " + WHITESPACE_BUT_SPACE
CONTROL = "\\x00-\\x1f\\x7f-\\x9f"

MARK_SPACE = "\u00b7"


def has_text(value: Column) -> Column:
    """At least one character that is not whitespace."""
    return value.rlike(f"[^{WHITESPACE}]")


def has_leading_whitespace(value: Column) -> Column:
    return value.rlike(f"\\A[{WHITESPACE}]")


def has_trailing_whitespace(value: Column) -> Column:
    return value.rlike(f"[{WHITESPACE}]\\z")


def has_other_whitespace(value: Column) -> Column:
    """Any whitespace but the ASCII space."""
    return value.rlike(f"[{WHITESPACE_BUT_SPACE}]")


def has_control(value: Column) -> Column:
    """C0 control, DEL or C1 control."""
    return value.rlike(f"[{CONTROL}]")


def is_printable_ascii(value: Column) -> Column:
    """Only U+0020 to U+007E: the cheap test that clears most fields at once."""
    return ~value.rlike("[^ -~]")


def is_calm(value: Column) -> Column:
    """Neither control characters nor whitespace other than inner ASCII spaces."""
    edge = value.startswith(" ") | value.endswith(" ")
    return ~edge & (
        is_printable_ascii(value) | ~value.rlike(f"[{CONTROL}{WHITESPACE_BUT_SPACE}]")
    )


def mark_whitespace(value: Column) -> Column:
    """Show whitespace as visible marks; a CRLF pair gives one mark."""
    single = F.replace(value, F.lit("\r\n"), F.lit("\n"))
    # The marks for space, ideographic space, tab, line ends and NBSP.
    return F.translate(single, " \u3000\t\r\n\u00a0", "\u00b7\u25a1\u2192\u21b5\u21b5\u237d")


def preview_field(
    value: Column, padding: Column, alignment: str = "left", marks: bool = True
) -> Column:
    """A field as the preview shows it: the value, and a dot per padding byte."""
    shown = mark_whitespace(value) if marks else value
    dots = F.repeat(F.lit(MARK_SPACE), padding)
    return F.concat(shown, dots) if alignment == "left" else F.concat(dots, shown)


def output_name(name: Column) -> Column:
    """Name of the fixed-width file made from a source file."""
    return F.concat(F.regexp_replace(name, "(?i)\\.(?:csv|xlsx?)\\z", ""), F.lit(".txt"))


def mask_value(value: Column) -> Column:
    """Hide a value that goes into a report: letters and any other script as x, digits as 0.

    Blanks and ASCII punctuation stay, so that the shape of the value can be seen.
    """
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[^\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f\u3000]", "x")


def csv_field(value: Column, delimiter: str = ",") -> Column:
    """A value as a CSV field, quoted only when it must be."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    if delimiter == ",":
        return F.when(value.rlike('[",\\r\\n]'), quoted).otherwise(value)
    return F.when(value.rlike('["\\r\\n]') | F.contains(value, F.lit(delimiter)), quoted).otherwise(value)


def csv_record(fields: Column, delimiter: str = ",") -> Column:
    """An array of values as one CSV record without its line end."""
    return F.array_join(F.transform(fields, lambda v: csv_field(v, delimiter)), delimiter)

"""Layout of a fixed-width record: byte widths, defaults and required flags."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

VERSION = 2
SOURCE_ENCODINGS = ("auto", "utf-8", "utf-16", "big5")
ALIGNMENTS = ("left", "right")
MAX_SETTINGS_BYTES = 1024 * 1024

# Byte widths and expected rows of the built-in 15-field layout.
BUILT_IN_WIDTHS = (1, 2, 1, 10, 10, 8, 12, 1, 120, 15, 10, 1, 8, 8, 1)
BUILT_IN_EXPECTED_ROWS = 200

LAYOUT_SCHEMA = (
    "layout_id string, field_index int, required boolean, default_value string, width_bytes int"
)

# What a settings document must hold: property, kind of its value, allowed values. Checked
# here for one document and in `operators.layouts` for a column of documents.
INTEGER, TEXT, FLAG, LIST = "positive whole number", "text", "flag", "filled list"
Shape = dict[str, tuple[str, tuple | None]]
DOCUMENT_SHAPE: Shape = {
    "version": (INTEGER, (VERSION,)),
    "sourceEncoding": (TEXT, SOURCE_ENCODINGS),
    "alignment": (TEXT, ALIGNMENTS),
    "expectedRows": (INTEGER, None),
    "columns": (LIST, None),
}
COLUMN_SHAPE: Shape = {"required": (FLAG, None), "defaultValue": (TEXT, None), "widthBytes": (INTEGER, None)}


class InvalidSettings(ValueError):
    """A settings document that does not describe a usable layout."""


@dataclass(frozen=True)
class FieldSpec:
    width_bytes: int
    required: bool = False
    default_value: str = ""


@dataclass(frozen=True)
class Layout:
    fields: tuple[FieldSpec, ...]
    expected_rows: int | None = None
    alignment: str = "left"
    source_encoding: str = "auto"

    def __post_init__(self) -> None:
        if not self.fields:
            raise InvalidSettings("a layout needs at least one field")
        if self.alignment not in ALIGNMENTS:
            raise InvalidSettings(f"unknown alignment {self.alignment!r}")
        if self.source_encoding not in SOURCE_ENCODINGS:
            raise InvalidSettings(f"unknown source encoding {self.source_encoding!r}")
        if self.expected_rows is not None and not _positive_integer(self.expected_rows):
            raise InvalidSettings("expected rows must be a positive integer")
        for position, field in enumerate(self.fields, start=1):
            if not _positive_integer(field.width_bytes):
                raise InvalidSettings(f"width of field {position} must be a positive integer")

    @classmethod
    def of_widths(cls, widths: Sequence[int], **options: Any) -> Layout:
        return cls(tuple(FieldSpec(width) for width in widths), **options)

    @classmethod
    def built_in(cls) -> Layout:
        return cls.of_widths(BUILT_IN_WIDTHS, expected_rows=BUILT_IN_EXPECTED_ROWS)

    @classmethod
    def from_json(cls, text: str) -> Layout:
        """Load a settings document, clearing the default of a required field."""
        size = len(text.encode("utf-8"))
        if size == 0:
            raise InvalidSettings("the settings document is empty")
        if size > MAX_SETTINGS_BYTES:
            raise InvalidSettings("the settings document is larger than 1 MiB")
        try:
            document = json.loads(text)
        except ValueError as error:
            raise InvalidSettings("the settings document is not JSON") from error
        if not _fits(document, DOCUMENT_SHAPE) or not all(_fits(column, COLUMN_SHAPE) for column in document["columns"]):
            raise InvalidSettings("the settings document has a wrong shape or version")
        return cls(
            fields=tuple(
                FieldSpec(
                    width_bytes=int(column["widthBytes"]),
                    required=column["required"],
                    default_value="" if column["required"] else column["defaultValue"],
                )
                for column in document["columns"]
            ),
            expected_rows=int(document["expectedRows"]),
            alignment=document["alignment"],
            source_encoding=document["sourceEncoding"],
        )

    def to_json(self) -> str:
        document = {
            "version": VERSION,
            "sourceEncoding": self.source_encoding,
            "alignment": self.alignment,
            "expectedRows": self.expected_rows,
            "columns": [
                {
                    "required": field.required,
                    "defaultValue": field.default_value,
                    "widthBytes": field.width_bytes,
                }
                for field in self.fields
            ],
        }
        return json.dumps(document, ensure_ascii=False, indent=2) + "\n"

    @property
    def widths(self) -> tuple[int, ...]:
        return tuple(field.width_bytes for field in self.fields)

    @property
    def record_width(self) -> int:
        return sum(self.widths)

    @property
    def starts(self) -> tuple[int, ...]:
        """1-based first byte of every field."""
        starts, position = [], 1
        for width in self.widths:
            starts.append(position)
            position += width
        return tuple(starts)

    def with_options(self, **options: Any) -> Layout:
        return replace(self, **options)

    def to_dataframe(self, spark: SparkSession, layout_id: str = "built-in") -> DataFrame:
        return spark.createDataFrame(
            [
                (layout_id, index, field.required, field.default_value, field.width_bytes)
                for index, field in enumerate(self.fields, start=1)
            ],
            LAYOUT_SCHEMA,
        )


def _positive_integer(value: Any) -> bool:
    if isinstance(value, bool):
        return False
    if isinstance(value, float):
        return value.is_integer() and value > 0
    return isinstance(value, int) and value > 0


_FITS = {
    INTEGER: _positive_integer,
    TEXT: lambda value: isinstance(value, str),
    FLAG: lambda value: isinstance(value, bool),
    LIST: lambda value: isinstance(value, list) and len(value) > 0,
}


def _fits(value: Any, shape: Shape) -> bool:
    """Whether a JSON value is an object with all properties of a shape."""
    return isinstance(value, dict) and all(
        name in value and _FITS[kind](value[name]) and (allowed is None or value[name] in allowed)
        for name, (kind, allowed) in shape.items()
    )

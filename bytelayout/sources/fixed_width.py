"""Fixed-width Big5 files read back by their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelayout.functions.charset import BIG5, decode_big5
from bytelayout.layout import Layout
from bytelayout.plans.joins import join_small
from bytelayout.session import charset_flags
from bytelayout.sources.lines import block_counts, line_offset, rows_before, scan_lines

UTF8_MARK = b"\xef\xbb\xbf"


def _unescaped(name: Column) -> Column:
    """A name as it was before it became part of an address; folder names are escaped on their own before."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_records(spark: SparkSession, path: str | list[str], layout: Layout) -> DataFrame:
    """`file_id`, `record_no`, `record` of CRLF-ended files, `well_sized` by the layout.

    Records hold no control characters, so CRLF splits files of any size at record
    bounds. Part files written by `sink.write_records` come back as one file, with
    the directory name as `file_id`.
    """
    lines = scan_lines(spark, path, "\r\n")
    blocks = block_counts(lines)
    owner = F.when(
        F.col("file_id").rlike("/file=[^/]*/part=[^/]*/[^/]*\\z"),
        _unescaped(_unescaped(F.regexp_extract("file_id", "/file=([^/]*)/part=", 1))),
    ).otherwise(F.col("file_id"))
    ordered = blocks.select(
        F.col("file_id").alias("path"), "block", "lines", "first_at", owner.alias("file_id"),
        F.struct(F.col("file_id").alias("path"), "block").alias("_order"),
    )
    placed = ordered.withColumn("_before", rows_before("lines", "_order")).drop("_order")
    joined = join_small(
        lines.withColumnRenamed("file_id", "path"), placed, ["path", "block"], "inner"
    )
    offset = line_offset(F.col("at"), F.col("first_at"), F.col("lines"))
    # The reader takes EF BB BF off the head of a file as a UTF-8 mark; in Big5 these
    # bytes are text, and the first record is then three bytes short.
    shortened = (
        (F.col("block") == 0)
        & (offset == 0)
        & (F.octet_length("line") == layout.record_width - len(UTF8_MARK))
    )
    record = F.when(shortened, F.concat(F.lit(UTF8_MARK), F.col("line"))).otherwise(F.col("line"))
    return joined.select(
        "file_id", (F.col("_before") + offset + 1).alias("record_no"), record.alias("record")
    ).withColumn("well_sized", F.octet_length("record") == layout.record_width)


def field_bytes(record: Column, layout: Layout) -> Column:
    """Array of the bytes of each field, padding included."""
    return F.array(
        *[
            F.substring(record, start, width)
            for start, width in zip(layout.starts, layout.widths)
        ]
    )


def trim_padding(data: Column, alignment: str) -> Column:
    """Text without the spaces on the padded side."""
    return F.rtrim(data) if alignment == "left" else F.ltrim(data)


def with_fields(
    records: DataFrame, layout: Layout, charset: str = BIG5, trim: bool = True
) -> DataFrame:
    """Add `fields`: decoded values by the layout, NULL where bytes are not valid Big5.

    `trim` takes the padding off, and with it spaces of the value on that side.
    """
    def value(data: Column) -> Column:
        decoded = decode_big5(data, charset)
        return trim_padding(decoded, layout.alignment) if trim else decoded

    with charset_flags(records.sparkSession):
        return records.withColumn("fields", F.transform(field_bytes(F.col("record"), layout), value))


def read_fixed_width(
    spark: SparkSession, path: str | list[str], layout: Layout, charset: str = BIG5, trim: bool = True
) -> DataFrame:
    """Records of fixed-width files with their decoded `fields`."""
    return with_fields(read_records(spark, path, layout), layout, charset, trim)

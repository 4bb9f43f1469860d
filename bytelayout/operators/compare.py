"""Comparison of two versions of fixed-width files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelayout.layout import Layout
from bytelayout.plans.joins import join_small
from bytelayout.session import materialize
from bytelayout.sources.fixed_width import field_bytes

RECORDS_PER_BLOCK = 100_000


def _block_prints(records: DataFrame, name: str) -> DataFrame:
    """Size, count and a 128-bit fingerprint of each block of records, map-side combined."""
    block = F.floor((F.col("record_no") - 1) / RECORDS_PER_BLOCK)
    return records.groupBy("file_id", block.alias("_block")).agg(
        F.struct(
            F.count(F.lit(1)).alias("records"),
            F.sum(F.octet_length("record")).cast("bigint").alias("bytes"),
            F.bit_xor(F.xxhash64("record_no", "record")).alias("one"),
            F.bit_xor(F.xxhash64("record", "record_no", F.lit("second"))).alias("two"),
        ).alias(name)
    )


def first_different_field(left: Column, right: Column, layout: Layout) -> Column:
    """1-based number of the first field whose bytes differ; NULL if a side is missing."""
    differs = F.zip_with(
        field_bytes(left, layout), field_bytes(right, layout), lambda a, b: ~a.eqNullSafe(b)
    )
    at = F.array_position(differs, True)
    return F.when(left.isNotNull() & right.isNotNull() & (at > 0), at)


def compare_files(left: DataFrame, right: DataFrame, layout: Layout) -> DataFrame:
    """Per file: sizes, counts, whether equal, first differing record and field.

    Both sides hold `file_id`, `record_no` and `record`. Blocks of records are
    compared by fingerprint first; only records of differing blocks are joined.
    """
    prints = materialize(
        _block_prints(left, "left").join(_block_prints(right, "right"), ["file_id", "_block"], "full")
    )
    differing = materialize(prints.filter(~F.col("left").eqNullSafe(F.col("right"))).select("file_id", "_block"))
    block = F.floor((F.col("record_no") - 1) / RECORDS_PER_BLOCK)

    def suspects(records: DataFrame, name: str) -> DataFrame:
        chosen = join_small(
            records.withColumn("_block", block), differing, ["file_id", "_block"], "left_semi",
            spread_by=F.col("record_no"), ready=True,
        )
        return chosen.select("file_id", "record_no", F.col("record").alias(name))

    pairs = suspects(left, "left").join(suspects(right, "right"), ["file_id", "record_no"], "full")
    changed = pairs.filter(~F.col("left").eqNullSafe(F.col("right")))
    first = changed.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("different_records"),
        F.min_by(
            F.struct("record_no", first_different_field(F.col("left"), F.col("right"), layout).alias("field")),
            "record_no",
        ).alias("first"),
    )
    totals = prints.groupBy("file_id").agg(
        *[
            F.coalesce(F.sum(f"{side}.{what}"), F.lit(0)).alias(f"{side}_{what}")
            for side in ("left", "right")
            for what in ("records", "bytes")
        ]
    )
    return totals.join(first, "file_id", "left").select(
        "file_id", "left_records", "right_records", "left_bytes", "right_bytes",
        F.coalesce("different_records", F.lit(0)).alias("different_records"),
        F.col("different_records").isNull().alias("equal"),
        F.col("first.record_no").alias("first_record"),
        F.col("first.field").cast("int").alias("first_field"),
    )

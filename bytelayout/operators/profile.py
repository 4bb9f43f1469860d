"""Profiles that show no content, digests, and characters that do not encode."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelayout.functions.charset import BIG5, encode_big5
from bytelayout.layout import Layout
from bytelayout.session import charset_flags

GROUP = 4096


def profile_fields(validated: DataFrame, layout: Layout) -> DataFrame:
    """Per file and field: empty values, byte lengths, overflows, unencodable values."""
    widths = F.array(*[F.lit(width) for width in layout.widths])
    opened = validated.select(
        "file_id",
        F.posexplode(
            F.transform(
                "encoded",
                lambda data, at: F.struct(
                    (F.get("fields", at) == "").alias("empty"), F.octet_length(data).alias("size")
                ),
            )
        ).alias("at", "field"),
    )
    size = F.col("field.size")
    return opened.groupBy("file_id", (F.col("at") + 1).alias("field_index")).agg(
        F.count(F.lit(1)).alias("value_count"),
        F.count_if("field.empty").alias("empty_count"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
        F.count_if(size > F.get(widths, F.col("at"))).alias("overflow_count"),
        F.count_if(size.isNull()).alias("unencodable_count"),
    )


def profile_files(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per file: records, and the smallest and largest number of fields.

    With `files` (`file_id`, `size`, as `list_files` gives them) also `size_bytes`, and a
    row for files without any record.
    """
    counts = rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(F.size("fields")).alias("min_columns"),
        F.max(F.size("fields")).alias("max_columns"),
    )
    if files is None:
        return counts
    sizes = files.select("file_id", F.col("size").cast("bigint").alias("size_bytes"))
    return sizes.join(counts, "file_id", "left").na.fill(0, ["record_count"])


def unencodable_characters(values: DataFrame, charset: str = BIG5, value: str = "value") -> DataFrame:
    """Characters that kept a value from being encoded, with how often they occur.

    Other columns of `values` are the groups. Only values that fail as a whole are
    opened; characters are counted first and tested once each.
    """
    groups = [name for name in values.columns if name != value]
    with charset_flags(values.sparkSession):
        failing = values.filter(encode_big5(F.col(value), charset).isNull())
        counted = (
            failing.select(*groups, F.explode(F.split(value, "")).alias("character"))
            .groupBy(*groups, "character")
            .agg(F.count(F.lit(1)).alias("occurrences"))
        )
        return counted.filter(encode_big5(F.col("character"), charset).isNull()).select(
            *groups,
            "character",
            F.format_string("U+%04X", _code_point(F.col("character"))).alias("code_point"),
            "occurrences",
        )


def _code_point(character: Column) -> Column:
    return F.conv(F.hex(F.encode(character, "UTF-32BE")), 16, 10).cast("bigint")


def record_digests(records: DataFrame, record: str = "record") -> DataFrame:
    """Add `sha256` of each record."""
    return records.withColumn("sha256", F.sha2(record, 256))


def file_digests(
    records: DataFrame, order: str = "record_no", record: str = "record", group: int = GROUP
) -> DataFrame:
    """`tree_sha256` per file: SHA-256 over digests, `group` at a time, level by level.

    No task ever holds more than `group` digests, and there are as many levels as the
    largest record number needs, one at least. Above the first level a digest without
    neighbours is passed on as it is, so that a file's value does not depend on other
    files. It depends on the records and their order; it is not the SHA-256 of the file's bytes, see `file_sha256`.
    """
    left, levels = records.agg(F.max(order)).first()[0] or 1, 1
    while (left := -(-left // group)) > 1:
        levels += 1
    level = records.select(
        "file_id", (F.col(order) - 1).alias("_at"), F.sha2(record, 256).alias("digest"),
        F.octet_length(record).cast("bigint").alias("bytes"), F.lit(1).alias("count"),
    )
    for at in range(levels):
        ordered = F.array_sort(F.collect_list(F.struct("_at", "digest")))
        level = (
            level.groupBy("file_id", F.floor(F.col("_at") / group).alias("_group"))
            .agg(
                F.when(F.lit(at > 0) & (F.count(F.lit(1)) == 1), F.max("digest")).otherwise(
                    F.sha2(F.array_join(F.transform(ordered, lambda entry: entry["digest"]), ""), 256)
                ).alias("digest"),
                F.sum("bytes").alias("bytes"),
                F.sum("count").alias("count"),
            )
            .withColumnRenamed("_group", "_at")
        )
    return level.select(
        "file_id", F.col("count").alias("record_count"), F.col("bytes").alias("size_bytes"),
        F.col("digest").alias("tree_sha256"),
    )


def file_sha256(records: DataFrame, order: str = "record_no", record: str = "record") -> DataFrame:
    """`size_bytes` and `sha256` of a file's bytes, of any size.

    SHA-256 runs from the first byte to the last, so the records of one file pass one
    task, sorted, and are forgotten as they pass; use `file_digests` where files are large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_id, digest, size, done = None, None, 0, []

        def close() -> None:
            if digest is not None:
                done.append((file_id, size, digest.hexdigest()))

        for batch in batches:
            for name, data in zip(batch.column("file_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if digest is None or name != file_id:
                    close()
                    file_id, digest, size = name, hashlib.sha256(), 0
                digest.update(data or b"")
                size += len(data or b"")
            if len(done) >= 1000:
                yield _digest_rows(done)
                done.clear()
        close()
        if done:
            yield _digest_rows(done)

    placed = records.select("file_id", F.col(order).alias("at"), F.col(record).alias("record")).repartition("file_id")
    ordered = placed.sortWithinPartitions("file_id", "at").select("file_id", "record")
    return ordered.mapInArrow(run, "file_id string, size_bytes bigint, sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file_id": pa.string(), "size_bytes": pa.int64(), "sha256": pa.string()}
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, list(kinds))

"""Any DataFrame as a source of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bytelayout.functions.render import typed_text
from bytelayout.plans.joins import join_small
from bytelayout.session import materialize


def table_rows(
    df: DataFrame,
    fields: Sequence[str | tuple[str, str]],
    file_id: str | Column,
    source_row: str | Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Records from the columns `fields`, in layout order, NULL as an empty value.

    A field is a column name, or a name and a display format for a column that is
    not text. `source_row` is a column that already numbers the rows; see
    `number_rows` for a table without one.
    """
    types = dict(df.dtypes)
    values = []
    for field in fields:
        name, number_format = (field, None) if isinstance(field, str) else field
        values.append(F.coalesce(typed_text(F.col(name), types[name], number_format), F.lit("")))
    return df.select(
        (F.col(file_id) if isinstance(file_id, str) else file_id).cast("string").alias("file_id"),
        (F.col(source_row) if isinstance(source_row, str) else source_row).cast("bigint").alias("source_row"),
        F.array(*values).alias("fields"),
        *keep,
    )


def number_rows(df: DataFrame, file_id: str, order_by: Sequence[str]) -> DataFrame:
    """Add `source_row`, 1 to n per file in the given order, without a task per file.

    The rows are range-sorted once and kept; each (file, partition) then only needs
    the number of rows before it, a prefix sum over one row per file and partition.
    """
    ordered = df.repartitionByRange(file_id, *order_by).sortWithinPartitions(file_id, *order_by)
    placed = materialize(ordered).withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_part", F.spark_partition_id()
    )
    starts = placed.groupBy(file_id, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    before = F.sum("_rows").over(
        W.partitionBy(file_id).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = starts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    numbered = join_small(placed, starts, [file_id, "_part"], "inner", spread_by=F.col("_at"))
    return numbered.withColumn(
        "source_row", F.col("_before") + F.col("_at") - F.col("_first") + 1
    ).drop("_at", "_part", "_before", "_first")

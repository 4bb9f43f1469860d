"""Joining large row sets to small per-file or per-block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelayout.session import materialize

# Measured size up to which a small side is broadcast. A table of splits, some 150 bytes a
# row, stays below it up to about 100 TB.
BROADCAST_BYTES = 128 << 20
SALTS = 64


def table_bytes(small: DataFrame) -> int:
    """Bytes of a narrow table: its texts and binaries, and 8 for any other value."""
    sizes = [
        F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 8 if kind in ("string", "binary") else F.lit(8)
        for name, kind in small.dtypes
    ]
    return small.agg(F.sum(sum(sizes, F.lit(0)).cast("bigint"))).first()[0] or 0


def fits_broadcast(small: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    return table_bytes(small) <= broadcast_bytes


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    spread_by: Column | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    ready: bool = False,
) -> DataFrame:
    """Join `big` to a table with one row per key, by a checked strategy.

    The small side is materialized (unless it is `ready`) and measured. It is broadcast only up to
    `broadcast_bytes`. Beyond that both sides are shuffled; with `spread_by` (a
    column that varies within one key) each key is salted so that a file holding
    a large part of all rows is spread over many tasks. `how` must keep only
    left rows: inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if not ready:
        small = materialize(small)
    if fits_broadcast(small, broadcast_bytes):
        return big.join(F.broadcast(small), on, how)
    if spread_by is None:
        return big.join(small, on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")

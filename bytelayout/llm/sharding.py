"""Rendezvous hashing of record keys over weighted shards, in built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bytelayout.llm.rows import named

# Rows of one shard are numbered in so many parts at the same time.
SLOT_BUCKETS = 512


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1), the same for a key and a shard on any engine: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def score(key: Column, shard: int, weight: float) -> Column:
    """Weighted rendezvous score: of all shards, one wins with probability weight / sum of weights."""
    return F.lit(-float(weight)) / F.ln(draw(key, shard))


def winner(scores: Sequence[Column]) -> Column:
    """Number of the largest score, the smallest such number in a tie."""
    ranked = [F.struct(value.alias("score"), F.lit(-at).alias("shard")) for at, value in enumerate(scores)]
    best = ranked[0] if len(ranked) == 1 else F.greatest(*ranked)
    return -best["shard"]


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 to n-1 of a text key.

    Each shard's score depends on the key and on that shard alone, so one more shard
    takes rows only into itself, and a changed weight moves rows only from or to the
    shard whose weight it is. A null key is the key of no characters.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    return winner([score(key, at, weight) for at, weight in enumerate(weights)])


def shard(
    docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text",
    grown_weight: float | None = None, buckets: int = SLOT_BUCKETS,
) -> DataFrame:
    """`doc_id`, `size`, `text_crc32`, `shard`, `slot`, `grown_shard`, a row per row.

    `size` is the UTF-8 bytes of the text plus 1; a null text counts as empty (size 1,
    checksum 0). `slot` numbers the rows of a shard from 0 without gaps, by bucket of
    the id and then by id, size and checksum; rows that repeat all three take the slots
    in between in any order. `grown_shard` is the shard if one more of `grown_weight`
    stood at the end, null without one. Null ids share a shard, but not a bucket.

    Nothing but narrow rows is shuffled, once: a slot is the row's place in its bucket
    plus the rows of the shard's earlier buckets, a table of shards x buckets rows.
    """
    key = F.coalesce(named(docs, id_col).cast("string"), F.lit(""))
    scores = [score(key, at, weight) for at, weight in enumerate(weights)]
    shard_of(key, weights)
    text = F.coalesce(named(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(
        named(docs, id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        winner(scores).cast("int").alias("shard"),
        (
            F.lit(None) if grown_weight is None else winner([*scores, score(key, len(weights), grown_weight)])
        ).cast("int").alias("grown_shard"),
        slot_bucket(key, F.crc32(text), buckets).alias("_bucket"),
    )
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")
    # At most shards x buckets rows, however large the input.
    return rows.join(F.broadcast(starts), ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("_start") + F.row_number().over(within) - 1).alias("slot"), "grown_shard",
    )


def slot_bucket(key: Column, crc: Column, buckets: int) -> Column:
    """Rows of one id share a bucket only if their texts do too."""
    mixed = F.md5(F.concat(key, F.lit("#"), crc.cast("string")))
    return (F.conv(F.substring(mixed, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")

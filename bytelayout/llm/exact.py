"""Exact deduplication by progressive refinement.

Rows are grouped by length, the rows of repeated lengths by a hash of their
first characters, and only what still stands in a group of two or more is told
apart by SHA-256 of the whole text. The groups work on narrow rows; no text is
ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelayout.llm.rows import id_and_text, named, one_row_each, without
from bytelayout.session import materialize

# Keys of 12 bytes that may be broadcast, checked by counting; beyond it every text is
# hashed where it is read, since moving hashes costs less than moving texts.
BROADCAST_KEYS = 200_000
PREFIX_CHARS = 64
KEY = ["n_bytes", "prefix"]


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `keep_id`, `group_size`, `kept`, `sha256` (binary).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the
    row with the largest `doc_id` stays (`keep_id`); a null id is smaller than any
    other. Rows that repeat both text and id are one document and are marked alike.
    `sha256` is null for rows whose text was told apart before its whole content was
    needed, unless `hash_all` asks for every row's. An empty table gives no rows.
    """
    source = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256)).alias("sha256")
    read = source.select(
        "doc_id",
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix"),
        *([digest] if hash_all else ["text"]),
    )
    facts = materialize(read if hash_all else read.drop("text"))

    lengths = facts.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    repeated = facts.join(lengths, "n_bytes", "left_semi").groupBy(KEY).count().where("count > 1").select(KEY)
    if hash_all:
        survivors, gone = facts.join(repeated, KEY, "left_semi"), facts.join(repeated, KEY, "left_anti")
    else:
        repeated = materialize(repeated)
        gone = facts.join(repeated, KEY, "left_anti").withColumn("sha256", F.lit(None).cast("binary"))
        if repeated.limit(broadcast_keys + 1).count() <= broadcast_keys:
            survivors = read.join(F.broadcast(repeated), KEY, "left_semi").select("doc_id", *KEY, digest)
        else:
            survivors = read.select("doc_id", *KEY, digest).join(repeated, KEY, "left_semi")

    groups = survivors.groupBy("n_bytes", "sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    ).where("group_size > 1")
    alone = gone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha256")
    told = survivors.join(groups, ["n_bytes", "sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        "sha256",
    )
    return told.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each text, with all its columns: of the largest id, see `exact_duplicates`.

    Of rows that share this id, or have none, any one stays.
    """
    found = exact_duplicates(docs, id_col, text_col).where("group_size > 1")
    found = materialize(found.select(F.col("doc_id").alias("_id"), F.col("sha256").alias("_mark"), "kept"))
    mark = F.unhex(F.sha2(F.coalesce(named(docs, text_col).cast("string"), F.lit("")), 256))
    rest = without(docs, found.where("NOT kept").drop("kept"), named(docs, id_col), mark)
    repeated = found.where("kept").groupBy("_id", "_mark").count().where("count > 1").drop("count")
    return one_row_each(rest, repeated, named(rest, id_col), mark)

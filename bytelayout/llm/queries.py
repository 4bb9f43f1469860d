"""The queries of this folder and their SQL: each runs its operator over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelayout.llm.bpe import round_trip
from bytelayout.llm.contamination import find_contamination
from bytelayout.llm.exact import exact_duplicates
from bytelayout.llm.html import extract
from bytelayout.llm.licenses import scan_licenses
from bytelayout.llm.lm import BACKOFF, MIN_COUNT, score_documents
from bytelayout.llm.negatives import hard_negatives
from bytelayout.llm.quality import THRESHOLD, fold, score_quality, train_quality
from bytelayout.llm.repeats import remove_repeats
from bytelayout.llm.sharding import SLOT_BUCKETS, shard
from bytelayout.llm.simhash import near_duplicates
from bytelayout.llm.vptree import NEIGHBOURS, nearest
from bytelayout.llm.whitening import fit_whitening, identity_error, whiten

SHARDS = 16
VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the bigrams of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 equal shards by rendezvous hashing of the id."""
    placed = shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown_weight=1.0)
    return placed.withColumn("law", F.lit("key"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = public_tokenizers.path(VOCABULARY)
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    # The url rides along in the id, so that nothing is joined or shuffled.
    found = extract(pages.withColumn("page", F.struct("page_id", "url")), id_col="page")
    return found.select("doc_id.page_id", "doc_id.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id of each stays."""
    found = exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by fingerprints at most 4 bits apart."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        (F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / 100.0).alias("score"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of benchmark items in every document."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that occurred before."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight principal components of all of them, at unit variance."""
    vectors = table(spark, sf_dir, "embeddings")
    model = fit_whitening(vectors)
    found = whiten(vectors, model).select("doc_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained())).cast("array<double>")
    return found.select(
        F.col("doc_id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"),
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other vectors to each whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), NEIGHBOURS)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each vector whose id is divisible by 50; one label in seven ids is wrong on purpose."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(vectors.withColumn("label", label), F.expr("vec_id % 50 = 0"))


QUERIES = {
    "op1_lm": op1_lm,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_html": op4_html,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_decontamination": op9_decontamination,
    "op10_repeats": op10_repeats,
    "op11_whitening": op11_whitening,
    "op12_neighbours": op12_neighbours,
    "op13_negatives": op13_negatives,
}

SQL_SHARDING = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    WITH RECURSIVE r(i, v, k) AS (
      SELECT i, i::BIGINT, 0 FROM range(256) g(i)
      UNION ALL
      SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM r WHERE k < 8
    ) SELECT i, v FROM r WHERE k = 8)
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc_table
), s AS (
  SELECT d.*, n, -1.0 / ln((('0x' || left(md5(key || '/' || n), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM d, range({SHARDS + 1}) g(n)
), w AS (
  SELECT doc_id, key, size, text_crc32,
    arg_max(n, score) FILTER (WHERE n < {SHARDS}) AS shard, arg_max(n, score) AS grown_shard
  FROM s GROUP BY ALL
), b AS (
  SELECT *, ('0x' || left(md5(key || '#' || text_crc32), 8))::BIGINT % {SLOT_BUCKETS} AS bucket FROM w
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard::INT AS grown_shard
FROM b
"""

SQL_EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL_CONTAMINATION = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
item AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS w FROM benchmark),
item_window AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
    lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS phrase FROM item WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT r, n, p.pos, array_to_string(w[p.pos : p.pos + n - 1], ' ') AS phrase
  FROM doc, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS pos) p
),
hit AS (SELECT r, d.n, d.pos, item_id FROM doc_window d JOIN item_window USING (n, phrase)),
hit_words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS x FROM hit) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

SQL_LM = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
tok AS (
  SELECT r, pos, w[pos] AS cur, CASE WHEN pos > 1 THEN w[pos - 1] END AS prev
  FROM doc, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS pos) p
),
one AS (SELECT cur, count(*) AS n FROM tok GROUP BY cur),
two AS (SELECT prev, cur, count(*) AS n FROM tok WHERE prev IS NOT NULL GROUP BY ALL),
total AS (SELECT count(*) AS n FROM tok),
scored AS (
  SELECT r, CASE WHEN tok.prev IS NOT NULL AND NOT coalesce(two.n >= {MIN_COUNT}, false) THEN 1 ELSE 0 END AS steps,
    CASE WHEN two.n >= {MIN_COUNT} THEN ln(two.n::DOUBLE / before.n)
      ELSE ln(one.n::DOUBLE / total.n) + CASE WHEN tok.prev IS NULL THEN 0 ELSE ln({BACKOFF}::DOUBLE) END END AS score
  FROM tok JOIN one ON tok.cur = one.cur LEFT JOIN two ON two.prev = tok.prev AND two.cur = tok.cur
    LEFT JOIN one AS before ON before.cur = tok.prev, total
)
SELECT doc_id, len(w)::BIGINT AS n_tokens, coalesce(sum(steps), 0)::BIGINT AS n_backoff,
  coalesce(sum(round(score * 1e6)::BIGINT), 0)::BIGINT AS log_micro
FROM doc LEFT JOIN scored USING (r) GROUP BY r, doc_id, w
"""

FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)))"
SQL_NEIGHBOURS = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
  WHERE {FINITE} AND list_bool_or(list_transform(embedding, lambda c: c <> 0))
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])), lambda a, b: a + b)) AS score
  FROM v AS q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= {NEIGHBOURS}
"""

SQL_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND {FINITE}
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * v.x[i]))::BIGINT AS score
  FROM v AS a, v WHERE a.vec_id % 50 = 0 AND v.vec_id <> a.vec_id AND len(v.x) = len(a.x)
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

SQL = {
    "op1_lm": SQL_LM,
    "op2_sharding": SQL_SHARDING,
    "op5_exact_dedup": SQL_EXACT,
    "op9_decontamination": SQL_CONTAMINATION,
    "op12_neighbours": SQL_NEIGHBOURS,
    "op13_negatives": SQL_NEGATIVES,
}

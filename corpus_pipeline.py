"""A corpus from raw documents to tokens, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bytelayout.llm.bpe import round_trip
from bytelayout.llm.contamination import drop_contaminated
from bytelayout.llm.exact import drop_exact_duplicates
from bytelayout.llm.jaccard import drop_similar
from bytelayout.llm.quality import keep_good, train_quality
from bytelayout.llm.queries import VOCABULARY
from bytelayout.session import work_path

# The last stage runs beside all that the others have left in the executors, so its workers hold half as many states.
BPE_STATES = 110_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels finds good enough."""
    return keep_good(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more the document with the smallest id.

    SimHash fingerprints found through Golay codes come first; minima of the shingles find what they leave.
    """
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, max_states=BPE_STATES)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

# A trained model, fingerprints and tokens have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

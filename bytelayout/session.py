"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Without these two, `encode`/`decode` refuse every charset outside a short list
# and raise on the first unmappable character.
CHARSET_FLAGS = {
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


@contextlib.contextmanager
def charset_flags(spark: SparkSession) -> Iterator[None]:
    """Allow Big5 charsets while a DataFrame is being built.

    Spark copies both flags into the expression when it analyses it, so they need
    to be on during construction only and are put back afterwards.
    """
    before = {key: spark.conf.get(key, None) for key in CHARSET_FLAGS}
    for key, value in CHARSET_FLAGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir` of the session.

    Where none is named, a session whose executors are threads of this process (as in
    tests) gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-bytelayout-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/bytelayout-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small evidence table with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it from there.

    For tables of any size that several jobs read: each reads only its columns, lost
    executors cost nothing that was written, and what made the table runs once.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

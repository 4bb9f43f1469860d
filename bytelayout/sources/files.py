"""Listing, typing and admitting source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_TYPES = ("csv", "xls", "xlsx")

UNSUPPORTED_TYPE = "unsupported file type"
EMPTY_FILE = "empty file"
TOO_LARGE = "file larger than the limit"


def file_type(name: Column) -> Column:
    """csv, xls or xlsx by the extension in any case, else NULL."""
    extension = F.lower(F.regexp_extract(name, "\\.([^.]+)\\z", 1))
    return F.when(extension.isin(*FILE_TYPES), extension)


def file_options(glob: str | None = None) -> dict[str, str]:
    """Reader options: all folders below the path, and only names that match `glob`."""
    options = {"recursiveFileLookup": "true"}
    return options if glob is None else {**options, "pathGlobFilter": glob}


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Files below a path by their metadata; no content is read."""
    found = spark.read.format("binaryFile").options(**file_options(glob)).load(path)
    sized = found.select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_size").alias("size"),
    )
    # Readers skip empty files, so those are known only from the driver's file index.
    indexed = spark.createDataFrame([(name,) for name in found.inputFiles()], "file_id string")
    indexed = indexed.select(F.regexp_replace("file_id", "^file:/+", "file:/").alias("file_id"))
    listed = indexed.join(sized, "file_id", "left").select(
        "file_id",
        F.regexp_extract("file_id", "([^/]*)\\z", 1).alias("name"),
        F.coalesce("size", F.lit(0)).alias("size"),
    )
    return listed.withColumn("name", F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B")))).withColumn(
        "file_type", file_type(F.col("name"))
    )


def admission_problem(
    kind: Column, size: Column, max_bytes: int | None = None, allow_empty: bool = False
) -> Column:
    """Why a file is refused before it is read, NULL when it is not."""
    problem = F.when(kind.isNull(), UNSUPPORTED_TYPE)
    if not allow_empty:
        problem = problem.when(size == 0, EMPTY_FILE)
    return problem if max_bytes is None else problem.when(size > max_bytes, TOO_LARGE)


def admit_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add `problem` to a table with `file_type` and `size`."""
    return files.withColumn("problem", admission_problem(F.col("file_type"), F.col("size"), max_bytes))

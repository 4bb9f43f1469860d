"""Columns and Arrow batches the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.session import materialize, work_path

# Rows of an Arrow batch that are worked on at a time, so that only their results and texts are held.
SLICE_ROWS = 256

# Narrow decision rows that may be broadcast, checked by counting.
BROADCAST_ROWS = 200_000

# An UTF-8 byte to what it counts as in a word: A-Z lower-cased, every other ASCII byte
# that is neither a digit nor a letter a blank, all bytes of non-ASCII characters kept.
FOLD = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20
    for b in range(256)
)


_held: dict[Hashable, object] = {}
_asked: list[bool] = []  # whether the operator of this task asked for what is held


def held_by_worker[Made](key: Hashable, make: Callable[[], Made]) -> Made:
    """What a Python worker keeps between tasks: of all operators only the last one's."""
    _asked.append(True)
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Give back the memory of the operator before, also what the allocators would keep for later."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def prepared[Made](each: Callable[[], Made]) -> Made:
    """`each()` at the start of a task; an operator that keeps nothing lets go of what another one kept."""
    _asked.clear()
    made = each()
    if not _asked and _held:
        let_go()
    return made


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of `work_path` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named tables of one job in the shared folder: written, read back, and removed when nothing reads them any more.

    They outlive executors as checkpoints do, but can be removed, and a small one is read by few tasks.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark, self.path = spark, work_path(spark, job)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove these tables, or all, and have the driver notice what is gone, so that Spark removes its shuffle files."""
        for path in [f"{self.path}/{name}" for name in names] or [self.path]:
            discard(self.spark, path)
        gc.collect()
        self.spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS))


def named(docs: DataFrame, name: str) -> Column:
    """A top-level column by its whole name, dots and all."""
    return docs[f"`{name}`"]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`doc_id` and `text`; every other column, whatever its name, is left behind."""
    return docs.select(named(docs, id_col).alias("doc_id"), named(docs, text_col).cast("string").alias("text"))


def id_field(docs: DataFrame) -> T.StructField:
    return T.StructField("doc_id", docs.schema["doc_id"].dataType)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, null as no bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def map_texts(
    docs: DataFrame, fields: list[T.StructField], each: Callable[[], Callable[[list[bytes]], list[list]]]
) -> DataFrame:
    """`doc_id` and new columns from the whole text of every row, a batch at a time.

    `each()` is called once in a task and gives the function that turns the texts
    of a batch into one list of values per new column.
    """
    schema = T.StructType([id_field(docs), *fields])
    kinds = [pa_type(field.dataType) for field in fields]
    names = [field.name for field in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepared(each)
        for batch in slices(batches):
            columns = work(as_bytes(batch.column("text")))
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(field.name, pa_type(field.dataType)) for field in kind.fields])
    return {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(FOLD).split()


def without(docs: DataFrame, dropped: DataFrame, id_value: Column, mark: Column) -> DataFrame:
    """Rows of `docs` whose id and mark are not among `dropped` (`_id`, `_mark`).

    The mark, a digest of the text, keeps rows apart that share an id or have none.
    """
    dropped = materialize(dropped.distinct())
    if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, id_value.eqNullSafe(dropped["_id"]) & (mark == dropped["_mark"]), "left_anti")


def one_row_each(docs: DataFrame, repeated: DataFrame, id_value: Column, mark: Column) -> DataFrame:
    """`docs` with one row for each id and mark among `repeated` (`_id`, `_mark`); all other rows as they are.

    Only rows of repeated ids and marks are moved, reduced to one within a task before.
    """
    repeated = materialize(repeated.distinct())
    if repeated.isEmpty():
        return docs
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    same = id_value.eqNullSafe(repeated["_id"]) & (mark == repeated["_mark"])
    names = [f"c{k}" for k in range(len(docs.columns))]  # the key columns must have names of their own
    twice = docs.join(repeated, same, "left_semi").select("*", id_value.alias("id of row"), mark.alias("mark of row"))
    once = twice.toDF(*names, "_id", "_mark").dropDuplicates(["_id", "_mark"]).select(*names).toDF(*docs.columns)
    return docs.join(repeated, same, "left_anti").union(once)


def keyed_by_text(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """`doc_id`, the id with a hash of the text, and `text` of every row; and that hash as a column of `docs`."""
    mark = F.xxhash64(named(docs, text_col))
    key = F.struct(named(docs, id_col).alias("id"), mark.alias("mark"))
    return docs.select(key.alias("doc_id"), named(docs, text_col).alias("text")), mark


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """One row of `docs` for each `component_id` of `found`, whose ids are those of `keyed_by_text`."""
    found = found.select(
        F.col("doc_id.id").alias("_id"), F.col("doc_id.mark").alias("_mark"), (F.col("doc_id") == F.col("component_id")).alias("stays")
    )
    found = materialize(found.groupBy("_id", "_mark", "stays").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR NOT stays"))
    rest = without(docs, found.where("NOT stays").select("_id", "_mark"), named(docs, id_col), mark)
    return one_row_each(rest, found.where("stays").select("_id", "_mark"), named(rest, id_col), mark)


def keep_where(
    docs: DataFrame, text_col: str, each: Callable[[], Callable[[list[bytes]], list[bool]]]
) -> DataFrame:
    """Whole rows of `docs` for which a function of the text says so; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepared(each)
        for batch in slices(batches):
            yield batch.filter(pa.array(work(as_bytes(batch.column(at))), pa.bool_()))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots would not be found
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)

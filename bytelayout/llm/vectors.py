"""Vectors of Arrow batches as matrices, the best few rows per query, and bounded parts of a query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.llm.rows import named

# Bytes of queries that are collected, sent to all tasks and looked for in one pass over the rows.
PART_BYTES = 16 << 20
# What stands in a place of `Best`: a row with an id, one without, no row.
WITH_ID, WITHOUT_ID, EMPTY = 0, 1, 2


def entries(df: DataFrame, name: str) -> Column:
    """A column of vectors as an array of floats or doubles."""
    column = named(df, name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType):
        return column
    return column.cast("array<double>")


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the rows whose vectors have that many entries, all finite, and the entries as doubles.

    Null and empty vectors, and those with a null, NaN or infinite entry, are in none.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(rows)).flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
        fine = np.isfinite(values).all(axis=1)
        yield rows[fine], values[fine]


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, zero where null, and whether there is one."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False).astype(np.int8)


def ids_column(ids: np.ndarray, state: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=state != WITH_ID)


class Best:
    """The `k` rows of least cost for every query; ties go to the smaller id, rows without an id come last of equals."""

    def __init__(self, queries: int, k: int, kind: type) -> None:
        self.k = k
        self.none = np.inf if kind is np.float64 else np.iinfo(kind).max
        self.cost = np.full((queries, k), self.none, kind)
        self.ids = np.zeros((queries, k), np.int64)
        self.state = np.full((queries, k), EMPTY, np.int8)

    def worst(self) -> np.ndarray:
        """The cost that a further row may have at most."""
        return np.where(self.state[:, -1] == EMPTY, self.none, self.cost[:, -1])

    def offer(self, queries: np.ndarray, cost: np.ndarray, ids: np.ndarray, state: np.ndarray) -> None:
        if not len(queries):
            return
        touched, place = np.unique(queries, return_inverse=True)
        held = np.repeat(np.arange(len(touched)), self.k)
        place = np.concatenate((held, place))
        cost = np.concatenate((self.cost[touched].ravel(), cost))
        ids = np.concatenate((self.ids[touched].ravel(), ids))
        state = np.concatenate((self.state[touched].ravel(), state))
        order = np.lexsort((ids, state, cost, state == EMPTY, place))
        first = np.searchsorted(place[order], np.arange(len(touched)))
        taken = order[(first[:, None] + np.arange(self.k)).ravel()]
        shape = (len(touched), self.k)
        self.cost[touched], self.ids[touched], self.state[touched] = cost[taken].reshape(shape), ids[taken].reshape(shape), state[taken].reshape(shape)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, cost, id and state of all rows held."""
        rows, places = np.nonzero(self.state != EMPTY)
        return rows, self.cost[rows, places], self.ids[rows, places], self.state[rows, places]


def parts_of(queries: DataFrame, row_bytes: Column, keys: list[str], part_bytes: int = PART_BYTES) -> Iterator[pa.Table]:
    """The whole query set in parts of about `part_bytes`, dealt by a hash of distinct rows."""
    total = queries.agg(F.sum(row_bytes).cast("bigint")).first()[0] or 0
    parts = -(-total // part_bytes)
    for part in range(parts):
        yield queries.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == part).toArrow()

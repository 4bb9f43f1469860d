"""Nearest neighbours by vantage-point trees, one per shard of rows.

A shard is some thousand rows that one task has read; no row is moved to build it, so no
shard grows with a hot key. A node of its tree keeps a vantage point and, for the nearer
and the farther half of its rows, the range of their distances to it. A query leaves out a
half whose range lies farther from its own distance to the vantage point than its kth
nearest so far, divided by `factor`: by the triangle inequality nothing is lost at 1, and
more is left out above.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelayout.llm.rows import named
from bytelayout.llm.vectors import PART_BYTES, WITHOUT_ID, Best, entries, ids_column, ids_of, matrices, parts_of
from bytelayout.session import work_path

NEIGHBOURS = 10
FACTOR = 2.0
SHARD_ROWS = 1 << 14
LEAF_ROWS = 128
# Vantage points tried for a node, rows they are judged by, and queries whose distances to a leaf are taken at once.
TRIED, JUDGED = 4, 64
QUERIES_AT_ONCE = 4096
# Rounding errors of distances, relative to the squared lengths of both vectors.
SLACK = 1e-10

TREE = "width int, rows int, ids binary, without_id binary, points binary, nodes binary"
NODE = np.dtype([("start", "<i4"), ("middle", "<i4"), ("end", "<i4"), ("near", "<i4"), ("far", "<i4"), ("range", "<f8", (4,))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, entries added up in order; beyond the range of doubles infinite."""
    total = np.zeros(len(b) if len(a) == 1 else len(a))
    with np.errstate(over="ignore"):
        for at in range(a.shape[1]):
            step = a[:, at] - b[:, at]
            total += step * step
    return np.sqrt(total)


def grow(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the nodes of a tree over it, root first.

    In the order, a node has its vantage point first, then the nearer half, then the farther one.
    """
    order = np.arange(len(points))
    nodes: list[tuple] = []
    random = np.random.default_rng(len(points))
    waiting = [(0, len(points), -1, "")]
    while waiting:
        start, end, parent, side = waiting.pop()
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        node = {"start": start, "middle": start, "end": end, "near": -1, "far": -1, "range": (0.0, 0.0, 0.0, 0.0)}
        nodes.append(node)
        if end - start <= leaf_rows:
            continue
        judged = points[order[random.integers(start, end, JUDGED)]]
        tried = random.integers(start, end, TRIED)
        with np.errstate(invalid="ignore"):
            spread = [distances(points[order[[place]]], judged).std() for place in tried]
        best = tried[int(np.argmax(np.nan_to_num(spread, nan=-1.0)))]
        order[[start, best]] = order[[best, start]]
        found = distances(points[order[[start]]], points[order[start + 1 : end]])
        half = len(found) // 2
        halves = np.argpartition(found, half)
        order[start + 1 : end] = order[start + 1 : end][halves]
        found = found[halves]
        middle = start + 1 + half
        node["middle"] = middle
        node["range"] = (found[:half].min(), found[:half].max(), found[half:].min(), found[half:].max())
        waiting += [(start + 1, middle, len(nodes) - 1, "near"), (middle, end, len(nodes) - 1, "far")]
    return order, np.array([tuple(node[name] for name in NODE.names) for node in nodes], NODE)


def bounds(node: np.void, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the rows of the nearer and the farther half are at least away from queries so far from the vantage point."""
    low, high, far_low, far_high = node["range"]
    with np.errstate(invalid="ignore"):
        slack = SLACK * (1 + apart)  # a distance is rounded, so that a range may seem farther than it is
        near = np.maximum(low - apart, apart - high) - slack
        far = np.maximum(far_low - apart, apart - far_high) - slack
    return np.fmax(near, 0), np.fmax(far, 0)  # differences of infinite distances say nothing


def planted(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return embeddings.select(named(embeddings, id_col).cast("long").alias("id"), entries(embeddings, vector_col).alias("vector"))


def build_index(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """A row per shard with the ids, vectors and tree of up to `shard_rows` rows of one width.

    Null, empty and all-zero vectors and those with a null, NaN or infinite entry are in no
    shard; all other rows are, repeated ones and those without an id too.
    """

    def tree(width: int, held: list[tuple]) -> pa.RecordBatch:
        ids, state, points = (np.concatenate(parts) for parts in zip(*held, strict=True))
        order, nodes = grow(points)
        columns = [[width], [len(ids)], *([part.tobytes()] for part in (ids[order], state[order], points[order], nodes))]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], TREE.replace(",", "").split()[::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:
            ids, state = ids_of(batch.column("id"))
            for rows, points in matrices(batch.column("vector")):
                some = points.any(axis=1)
                rows, points = rows[some], points[some]
                width = points.shape[1]
                for at in range(0, len(rows), shard_rows):
                    part = slice(at, at + shard_rows)
                    held = waiting.setdefault(width, [])
                    if sum(len(h[0]) for h in held) + len(rows[part]) > shard_rows:
                        yield tree(width, held)
                        held.clear()
                    held.append((ids[rows[part]], state[rows[part]], points[part]))
        for width, held in waiting.items():
            if held:
                yield tree(width, held)

    return planted(embeddings, id_col, vector_col).mapInArrow(run, TREE)


class Searcher:
    """The queries of a part, and the nearest rows found for them so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> None:
        self.ids, self.vectors, self.factor = ids, vectors, factor
        with np.errstate(over="ignore"):
            self.squares = (vectors * vectors).sum(1)
        self.best = Best(len(ids), k, np.float64)

    def shard(self, ids: np.ndarray, state: np.ndarray, points: np.ndarray, nodes: np.ndarray) -> None:
        """Each query first sees the leaf it falls into; then all walk the tree together, every node once."""
        with np.errstate(over="ignore"):
            rows = ids, state, points, (points * points).sum(1)
        home = self.leaves(points, nodes)
        for leaf in np.unique(home).tolist():
            self.compare(np.flatnonzero(home == leaf), slice(*nodes[["start", "end"]][leaf].tolist()), *rows)
        waiting = [(0, np.arange(len(self.ids)), np.zeros(len(self.ids)))]
        while waiting:
            at, asking, least = waiting.pop()
            asking = asking[least <= self.best.worst()[asking] / self.factor]
            if not len(asking):
                continue
            node = nodes[at]
            start, end = int(node["start"]), int(node["end"])
            if node["near"] < 0:
                self.compare(asking[home[asking] != at], slice(start, end), *rows)
                continue
            self.compare(asking, slice(start, start + 1), *rows)
            near, far = bounds(node, distances(self.vectors[asking], points[start : start + 1]))
            waiting += [(int(node["far"]), asking, far), (int(node["near"]), asking, near)]

    def leaves(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The leaf of each query, always going to the half it is nearer to."""
        home = np.zeros(len(self.ids), np.int64)
        for at, node in enumerate(nodes):
            if node["near"] >= 0:
                asking = np.flatnonzero(home == at)
                near, far = bounds(node, distances(self.vectors[asking], points[node["start"]][None]))
                home[asking] = np.where(near <= far, node["near"], node["far"])
        return home

    def compare(self, asking: np.ndarray, rows: slice, ids: np.ndarray, state: np.ndarray, points: np.ndarray, squares: np.ndarray) -> None:
        """Offer rows to queries; exact distances are taken only of rows that may be near enough."""
        for at in range(0, len(asking), QUERIES_AT_ONCE):
            part = asking[at : at + QUERIES_AT_ONCE]
            with np.errstate(over="ignore", invalid="ignore"):
                sums = self.squares[part, None] + squares[None, rows]
                about = sums - 2 * (self.vectors[part] @ points[rows].T)
                # What is no number, for vectors near the end of the range, is compared exactly.
                maybe = ~(about > (self.best.worst()[part] ** 2)[:, None] + SLACK * sums)
            maybe &= (ids[None, rows] != self.ids[part, None]) | (state[None, rows] == WITHOUT_ID)
            which, place = np.nonzero(maybe)
            which, place = part[which], place + rows.start
            self.best.offer(which, distances(self.vectors[which], points[place]), ids[place], state[place])


def search_part(index: DataFrame, part: pa.Table, k: int, factor: float) -> DataFrame:
    """`query`, `query_id`, `vec_id` and `score` of the nearest rows that each task finds for the queries of one part."""
    sets = {}
    ids, _ = ids_of(part.column("id").combine_chunks())
    for rows, points in matrices(part.column("vector").combine_chunks()):
        some = points.any(axis=1)
        sets[points.shape[1]] = rows[some], points[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = {width: Searcher(ids[rows], points, k, factor) for width, (rows, points) in sets.items()}
        for batch in batches:
            for at in range(batch.num_rows):
                shard = {name: batch.column(name)[at] for name in batch.schema.names}
                width = shard["width"].as_py()
                if width in searchers:
                    points = np.frombuffer(shard["points"].as_buffer()).reshape(-1, width)
                    parts = [np.frombuffer(shard[name].as_buffer(), kind) for name, kind in (("ids", np.int64), ("without_id", np.int8), ("nodes", NODE))]
                    searchers[width].shard(*parts[:2], points, parts[2])
        for width, searcher in searchers.items():
            which, score, found, state = searcher.best.found()
            columns = [pa.array(sets[width][0][which], pa.int64()), pa.array(searcher.ids[which]), ids_column(found, state), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query long, query_id long, vec_id long, score double")


def nearest(
    embeddings: DataFrame,
    asks: Column,
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The `k` nearest rows of every row where `asks`: `query_id`, `rank` from 1, `vec_id`, `score`.

    The score is the Euclidean distance in double precision, infinite beyond its range; ties go to
    the smaller id, rows without one come last of equals. Rows with the query's own id are never found,
    rows without an id ask nothing, equal rows ask once. Null, empty and all-zero vectors and those
    with a null, NaN or infinite entry neither ask nor are found; only vectors of one width are compared.
    Fewer than `k` rows are given where there are no more. `factor` 1 is exact; larger ones leave out more.

    Queries are looked for in parts of `part_bytes`, each sent to the tasks that hold the shards; a task
    keeps `k` rows a query over all its shards. Where there are several parts, shards are written once.
    """
    index = build_index(embeddings, id_col, vector_col)
    asked = planted(embeddings.where(asks), id_col, vector_col).where("id IS NOT NULL AND vector IS NOT NULL").dropDuplicates()
    order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last())

    def ranked(part: pa.Table) -> DataFrame:
        found = search_part(index, part, k, factor).withColumn("rank", F.row_number().over(order))
        return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    spark = embeddings.sparkSession
    parts = parts_of(asked, 16 + 8 * F.size("vector"), ["id", "vector"], part_bytes)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if second is None:
        return ranked(first)
    shards, path = work_path(spark, "shards"), work_path(spark, "nearest")
    index.write.parquet(shards)
    index = spark.read.parquet(shards)
    for part in itertools.chain((first, second), parts):
        ranked(part).write.mode("append").parquet(path)
    return spark.read.parquet(path)

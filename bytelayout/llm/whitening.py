"""Whitening of embeddings: principal components by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries are put on an integer grid, so counts and sums are exact whatever the order of
rows. The scatter is summed over centred values, a triangle of `width` by `width` numbers
a task, added up by Spark. Only that triangle, whose size depends on the width of the
vectors and not on their number, reaches the driver. There it is factored with pivoting
into L times its transpose, and the columns of L are rotated in pairs until they are
orthogonal: their squared norms are the eigenvalues, the columns at unit length the
components. The scatter itself is never rotated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelayout.llm.rows import id_field, named, slices
from bytelayout.llm.vectors import entries, matrices
from bytelayout.session import materialize

GRID, OFFSET = 1024, 100_000
COMPONENTS = 8
# A grid value is summed as three limbs, each far from overflow for 2^42 rows. Larger values count as not finite.
LIMB = 21
LIMIT = 1 << 61
EPS = np.finfo(np.float64).eps
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """What was fitted: `sums` of the grid values of `n` vectors, eigenvalues in falling order, components as columns."""

    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    def explained(self) -> list[float]:
        return (self.eigenvalues / self.trace).tolist()


def on_grid(column: pa.Array, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and grid values of the vectors of each width, or of the one given."""
    for rows, values in matrices(column):
        if width is None or values.shape[1] == width:
            scaled = np.floor(GRID * values)
            fine = (np.abs(scaled) < LIMIT).all(axis=1)
            yield rows[fine], scaled[fine].astype(np.int64) + OFFSET


def centred(grid: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Grid values minus their means: the whole part of a mean is taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (grid - whole) - rest


def grid_sums(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number and exact sums of the vectors of the commonest width (of equally common ones the larger)."""
    mask = np.int64((1 << LIMB) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, grid in on_grid(batch.column("vector")):
                if len(grid):
                    limbs = np.stack([(grid >> 2 * LIMB).sum(0), (grid >> LIMB & mask).sum(0), (grid & mask).sum(0)])
                    n, held = sums.get(grid.shape[1], (0, 0))
                    sums[grid.shape[1]] = (n + len(grid), held + limbs)
        for width, (n, limbs) in sums.items():
            columns = [[width] * width, range(width), [n] * width, *limbs]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["width", "at", "n", "a", "b", "c"])

    partial = vectors.select("vector").mapInArrow(run, "width long, at long, n long, a long, b long, c long")
    summed = materialize(partial.groupBy("width", "at").agg(*(F.sum(name).alias(name) for name in ("n", "a", "b", "c"))))
    most = summed.agg(F.max(F.struct("n", "width")).alias("most")).first().most
    if most is None:
        return 0, ()
    rows = summed.where(F.col("width") == most.width).orderBy("at").collect()
    return most.n, tuple((r.a << 2 * LIMB) + (r.b << LIMB) + r.c for r in rows)


def summed_products(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int) -> np.ndarray:
    """Sum over all tasks of the symmetric matrices that `values` makes of the batches' vectors."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for part in slices(iter([batch])):
                for matrix in values(part):
                    total += matrix.T @ matrix
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*upper, total[upper])], ["i", "j", "v"])

    partial = rows.mapInArrow(run, "i long, j long, v double")
    summed = partial.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    found = np.zeros((width, width))
    i, j, v = (summed.column(name).to_numpy() for name in ("i", "j", "v"))
    found[i, j] = found[j, i] = v
    return found


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and a lower trapezoidal factor of full rank, largest remaining variance first."""
    size = len(scatter)
    order, factor = np.arange(size), np.zeros((size, size))
    left = scatter.diagonal().copy()
    least = size * EPS * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        pivot = k + int(np.argmax(left[k:]))
        if left[pivot] <= least:
            return order, factor[:, :k]
        for swapped in (order, factor, left):
            swapped[[k, pivot]] = swapped[[pivot, k]]
        factor[k, k] = np.sqrt(left[k])
        below = slice(k + 1, size)
        factor[below, k] = (scatter[order[below], order[k]] - factor[below, :k] @ factor[k, :k]) / factor[k, k]
        left[below] -= factor[below, k] ** 2
    return order, factor


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns rotated in pairs until all are orthogonal.

    A round takes disjoint pairs at once, a sweep has every pair once.
    """
    columns = factor.copy()
    count = columns.shape[1]
    ring = np.arange(count + count % 2)
    half = len(ring) // 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(len(ring) - 1, 0)):
            left, right = ring[:half], ring[half:][::-1]
            real = (left < count) & (right < count)
            left, right = left[real], right[real]
            a, b = columns[:, left], columns[:, right]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > len(columns) * EPS * np.sqrt(aa * bb)
            if turn.any():
                turned = True
                left, right, a, b = left[turn], right[turn], a[:, turn], b[:, turn]
                slope = (bb[turn] - aa[turn]) / (2 * ab[turn])
                tangent = np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.sqrt(1 + slope * slope))
                cosine = 1 / np.sqrt(1 + tangent * tangent)
                sine = cosine * tangent
                columns[:, left], columns[:, right] = cosine * a - sine * b, sine * a + cosine * b
            ring[1:] = np.roll(ring[1:], 1)
        if not turned:
            break
    return columns


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the scatter in falling order and unit eigenvectors as columns, as many as its rank.

    The largest entry of a vector (of equal ones the first) is positive.
    """
    order, factor = pivoted_cholesky(scatter)
    columns = orthogonal_columns(factor)
    values = (columns * columns).sum(0)
    ranked = np.argsort(-values, kind="stable")
    values, columns = values[ranked], columns[:, ranked]
    vectors = np.empty_like(columns)
    vectors[order] = columns / np.sqrt(values)
    largest = np.argmax(np.abs(vectors), axis=0) if vectors.size else np.zeros(0, np.int64)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)


def prepared_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return embeddings.select(named(embeddings, id_col).alias("doc_id"), entries(embeddings, vector_col).alias("vector"))


def fit_whitening(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> Whitening:
    """Up to `components` principal components of the vectors on the grid: x = floor(1024 c) + 100000.

    Null and empty vectors and those with a null, NaN or infinite entry (or one of about 2e15
    and more) take no part; neither do vectors of another width than the commonest. Repeated
    rows count each time. Directions without variance, up to rounding, are no components: equal
    vectors, a single one, or none have no components at all. Covariances have the divisor n.
    """
    vectors = prepared_vectors(embeddings, id_col, vector_col)
    n, sums = grid_sums(vectors)
    if not n:
        return Whitening(0, (), 0.0, np.zeros(0), np.zeros((0, 0)))
    width = len(sums)

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (centred(grid, n, sums) for _, grid in on_grid(batch.column("vector"), width))

    scatter = summed_products(vectors.select("vector"), values, width)
    eigenvalues, found = principal(scatter)
    return Whitening(n, sums, float(np.trace(scatter)) / n, eigenvalues[:components] / n, found[:, :components])


def whitened_values(batch: pa.RecordBatch, model: Whitening) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, grid values and whitened values of the vectors of a batch."""
    for rows, grid in on_grid(batch.column("vector"), model.width):
        yield rows, grid, centred(grid, model.n, model.sums) @ model.components / np.sqrt(model.eigenvalues)


def identity_error(
    embeddings: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding"
) -> float:
    """Largest entry of the measured covariance of the whitened vectors minus the identity; 0 without components."""
    count = len(model.eigenvalues)
    if not count:
        return 0.0

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, found in whitened_values(batch, model):  # their mean is zero; a last column of ones gives what rounding left of it
            yield np.column_stack((found, np.ones(len(found))))

    products = summed_products(prepared_vectors(embeddings, id_col, vector_col), values, count + 1)
    mean = products[:count, count] / model.n
    return float(np.abs(products[:count, :count] / model.n - np.outer(mean, mean) - np.eye(count)).max())


def deviations(grid: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n x - S)^2, null where they are no 64-bit numbers."""
    largest = float(np.abs(centred(grid, model.n, model.sums)).max(initial=0.0)) * model.n + model.n
    highest = float(np.abs(grid).max(initial=0)) * model.n
    if largest**2 * model.width < 2**62 and highest < 2**62 and max(map(abs, model.sums)) < 2**62:
        return ((model.n * grid - np.array(model.sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((model.n * x - s) ** 2 for x, s in zip(row, model.sums, strict=True)) for row in grid.tolist()]
    return [value if value < 2**63 else None for value in exact]


def whiten(
    embeddings: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """`doc_id` (the id), `deviation` and `whitened` (a value per component) of every vector that may take part.

    `deviation` is the sum over dimensions of (n x - S)^2, exact; null where it is no 64-bit number.
    Vectors that `fit_whitening` leaves out have no row; nothing is shuffled.
    """
    vectors = prepared_vectors(embeddings, id_col, vector_col)
    kind = id_field(vectors).dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(iter([whole]))):
            for rows, grid, found in whitened_values(batch, model):
                ids = batch.column("doc_id").take(pa.array(rows))
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(grid, model), pa.int64()), lists], ["doc_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, f"doc_id {kind}, deviation long, whitened array<double>")

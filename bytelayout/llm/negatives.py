"""Hard negatives: rows of another label that score within a window below a positive.

Candidates are written as Parquet blocks in the order of a Hilbert curve, each block a row
and a row group of its own, with the least and largest entry of each dimension: its zone.
For an anchor, interval arithmetic over a zone bounds the scores in the block from both
sides. Zones alone are read to choose the blocks whose bounds meet what any anchor of a
part still looks for; only those are read then, and within them only the anchors whose own
bounds do so are scored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelayout.llm.rows import named
from bytelayout.llm.vectors import PART_BYTES, WITHOUT_ID, Best, entries, ids_column, ids_of, matrices, parts_of
from bytelayout.session import work_path

GRID = 256
# Larger grid values count as not finite, so that scores are exact 64-bit numbers for up to 2^14 dimensions.
LIMIT = 1 << 24
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # of a positive's score, in hundredths
BLOCK_ROWS = 1024
CURVE_BITS = 128
ANCHORS_AT_ONCE = 2048
# Blocks whose numbers the driver looks at to make a pruned scan, and ranges of such numbers in it.
LISTED, RANGES = 10_000, 64
UNKNOWN = np.iinfo(np.int64).min

BLOCK = "block long, width int, rows int, low array<int>, high array<int>, ids binary, without_id binary, labels binary, points binary"
NAMES = [field.split()[0] for field in BLOCK.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4]


def curve_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of `bits` bits a dimension, as rows of bytes that sort like them.

    Vectors are brought to equal length first, and cut into cells between -2 and 2 times their mean square entry.
    """
    size = np.sqrt((points.astype(np.float64) ** 2).mean(1, keepdims=True))
    cells = 1 << bits
    scaled = np.clip((points / np.where(size > 0, size, 1) + 2) / 4 * cells, 0, cells - 1)
    return along_curve(scaled.astype(np.uint32).T.copy(), bits)


def along_curve(axes: np.ndarray, bits: int) -> np.ndarray:
    """The same of cells given by their coordinates, an axis a row; the cells are written over.

    Skilling's transform: undo the excess work from the highest bit down, then Gray-encode.
    """
    for bit in range(bits - 1, 0, -1):
        here, below = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for axis in axes:
            on = (axis & here) != 0
            swap = np.where(on, 0, (axes[0] ^ axis) & below).astype(np.uint32)
            axes[0] ^= np.where(on, below, swap)
            axis ^= swap
    for at in range(1, len(axes)):
        axes[at] ^= axes[at - 1]
    flip = np.zeros(axes.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] >> np.uint32(bit) & np.uint32(1), np.uint32((1 << bit) - 1), np.uint32(0))
    axes ^= flip
    levels = [axes >> np.uint32(bit) & np.uint32(1) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels).T.astype(np.uint8), axis=1)


def on_grid(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """`id`, `label`, `width`, `point` (grid values, packed) and `key` of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in matrices(batch.column("vector")):
                scaled = np.floor(GRID * values)
                fine = (np.abs(scaled) < LIMIT).all(axis=1)
                rows, points = rows[fine], scaled[fine].astype(np.int32)
                width = points.shape[1]
                keys = curve_keys(points, min(16, -(-CURVE_BITS // width)))
                some = batch.select(["id", "label"]).take(pa.array(rows))
                columns = [some.column(0), some.column(1), pa.array(np.full(len(rows), width, np.int32)), packed(points), packed(keys)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "width", "point", "key"])

    chosen = embeddings.select(
        named(embeddings, id_col).cast("long").alias("id"), named(embeddings, label_col).cast("long").alias("label"),
        entries(embeddings, vector_col).alias("vector"),
    )
    chosen = chosen.where("label IS NOT NULL AND vector IS NOT NULL")
    return chosen.mapInArrow(run, "id long, label long, width int, point binary, key binary")


def packed(rows: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def write_blocks(rows: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """The rows of `on_grid` as a table of blocks along the curve.

    Rows at the same place of the curve are told apart by a hash, so that equal vectors, however many, fall into many ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)

        def block(width: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids, state = ids_of(table.column("id"))
            points = unpacked(table.column("point"), np.int32, width)
            labels = table.column("label").to_numpy(zero_copy_only=False)
            columns = [next(number), width, len(ids), points.min(0), points.max(0), *(part.tobytes() for part in (ids, state, labels, points))]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for start, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(widths)) + 1), len(widths)]):
                while start < end:
                    width = int(widths[start])
                    room = block_rows - sum(b.num_rows for b in held)
                    if held and (width != last or not room):
                        yield block(last, held)
                        held, room = [], block_rows
                    last, taken = width, min(room, end - start)
                    held.append(batch.slice(start, taken))
                    start += taken
        if held:
            yield block(last, held)

    spread = rows.withColumn("tie", F.xxhash64("id", F.monotonically_increasing_id()))
    ordered = spread.repartitionByRange("width", "key", "tie").sortWithinPartitions("width", "key", "tie")
    blocks = ordered.select("id", "label", "width", "point").mapInArrow(run, BLOCK)
    writer = blocks.write.option("parquet.block.size", 1 << 16).option("parquet.block.size.row.check.min", 1)
    writer.option("parquet.page.size.row.check.min", 1).parquet(path)


class Anchors:
    """The anchors of a part that have vectors of one width."""

    def __init__(self, rows: list[pa.RecordBatch], width: int) -> None:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        self.width = width
        self.ids, _ = ids_of(table.column("id"))
        self.labels = table.column("label").to_numpy()
        self.points = unpacked(table.column("point"), np.int32, width).astype(np.float64)
        self.largest = float(np.abs(self.points).max(initial=0.0))

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each anchor can have in a zone."""
        up, down = np.maximum(self.points, 0), np.maximum(-self.points, 0)
        least, most = up @ low - down @ high, up @ high - down @ low
        widest = np.maximum(np.abs(low), np.abs(high))
        if self.largest * float(widest.max()) * self.width >= 2**53:  # sums are rounded then
            slack = 1e-9 * (np.abs(self.points) @ widest)
            return least - slack, most + slack
        return least, most

    def scores(self, which: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Exact inner products; doubles hold them as long as all partial sums stay below 2^53."""
        if self.largest * float(np.abs(points).max(initial=0)) * self.width < 2**53:
            return (self.points[which] @ points.T.astype(np.float64)).astype(np.int64)
        return self.points[which].astype(np.int64) @ points.T.astype(np.int64)


# What an anchor looks for in a zone: which anchors may find something there, by their bounds of scores.
Wants = Callable[[Anchors, np.ndarray, np.ndarray], np.ndarray]


def zones(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    lows, highs = (batch.column(name).to_pylist() for name in ("low", "high"))
    for block, low, high in zip(batch.column("block").to_pylist(), lows, highs, strict=True):
        yield block, len(low), np.array(low, np.float64), np.array(high, np.float64)


def chosen_blocks(blocks: DataFrame, anchors: dict[int, Anchors], wants: Wants) -> DataFrame:
    """The blocks that any anchor wants, by their zones.

    Up to `LISTED` of them become ranges of numbers that prune the row groups of the scan; with more,
    all are read. In both cases a block that no anchor wants is left alone by `scored`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b for b, width, low, high in zones(batch) if width in anchors and wants(anchors[width], *anchors[width].bounds(low, high)).any()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["block"])

    listed = sorted(r.block for r in blocks.select("block", "low", "high").mapInArrow(run, "block long").limit(LISTED + 1).collect())
    return blocks if len(listed) > LISTED else blocks.where(in_ranges(listed))


def in_ranges(numbers: list[int]) -> Column:
    """A condition on `block` that holds for the sorted numbers and what lies in the smaller gaps between them."""
    if not numbers:
        return F.lit(False)
    gaps = sorted(range(1, len(numbers)), key=lambda at: numbers[at - 1] - numbers[at])[: RANGES - 1]
    cuts = [0, *sorted(at for at in gaps if numbers[at] - numbers[at - 1] > 1), len(numbers)]
    condition = F.lit(False)
    for start, end in itertools.pairwise(cuts):
        condition |= F.col("block").between(numbers[start], numbers[end - 1])
    return condition


def scored(
    blocks: DataFrame, anchors: dict[int, Anchors], wants: Wants, slots: int, k: int,
    offers: Callable[[Anchors, np.ndarray, np.ndarray, np.ndarray, Best], Iterator[tuple[np.ndarray, np.ndarray, int]]],
) -> DataFrame:
    """`width`, `anchor`, `slot`, `id`, `score`: for each of `slots` searches of an anchor the `k` best rows of each task.

    `offers` gives anchors, places and slot of scores that qualify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = {width: Best(len(some.ids) * slots, k, np.int64) for width, some in anchors.items()}
        for batch in batches:
            for at, (_, width, low, high) in enumerate(zones(batch)):
                if width not in anchors:
                    continue
                own, best = anchors[width], bests[width]
                asking = np.flatnonzero(wants(own, *own.bounds(low, high)))
                if not len(asking):
                    continue
                ids, state, labels, points = (np.frombuffer(batch.column(name)[at].as_buffer(), kind) for name, kind in (("ids", np.int64), ("without_id", np.int8), ("labels", np.int64), ("points", np.int32)))
                points = points.reshape(-1, width)
                for first in range(0, len(asking), ANCHORS_AT_ONCE):
                    which = asking[first : first + ANCHORS_AT_ONCE]
                    scores = own.scores(which, points)
                    other = (ids[None, :] != own.ids[which, None]) | (state[None, :] == WITHOUT_ID)
                    same = labels[None, :] == own.labels[which, None]
                    for rows, places, slot in offers(own, which, scores, other & same, other & ~same, best):
                        best.offer(which[rows] * slots + slot, -scores[rows, places], ids[places], state[places])
        for width, best in bests.items():
            which, cost, found, state = best.found()
            columns = [pa.array(np.full(len(which), width, np.int32)), pa.array(which // slots), pa.array((which % slots).astype(np.int32)), ids_column(found, state), pa.array(-cost)]
            yield pa.RecordBatch.from_arrays(columns, ["width", "anchor", "slot", "id", "score"])

    read = blocks.select(*NAMES)
    found = read.mapInArrow(run, "width int, anchor long, slot int, id long, score long")
    order = Window.partitionBy("width", "anchor", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_positives(blocks: DataFrame, anchors: dict[int, Anchors], k: int) -> DataFrame:
    """The first `k` other rows of each anchor's label: `width`, `anchor`, `id`, `score`, `rank`.

    First each anchor looks into the one block whose bound is highest. The kth score found there, if there
    are so many, is what a block must be able to reach to be read for that anchor afterwards.
    """

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {width: (np.full(len(some.ids), -np.inf), np.full(len(some.ids), -1)) for width, some in anchors.items()}
        for batch in batches:
            for block, width, low, high in zones(batch):
                if width in anchors:
                    reach, where = best[width]
                    _, most = anchors[width].bounds(low, high)
                    where[most > reach] = block
                    np.maximum(reach, most, out=reach)
        for width, (reach, where) in best.items():
            seen = np.flatnonzero(where >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), width, np.int32)), pa.array(seen), pa.array(reach[seen]), pa.array(where[seen])], ["width", "anchor", "reach", "block"])

    top = blocks.select("block", "low", "high").mapInArrow(tops, "width int, anchor long, reach double, block long")
    # As many rows as the part has anchors.
    homes = top.groupBy("width", "anchor").agg(F.max(F.struct("reach", "block")).alias("top")).select("width", "anchor", "top.*").collect()
    reach = {width: np.full(len(some.ids), np.inf) for width, some in anchors.items()}
    for row in homes:
        reach[row.width][row.anchor] = row.reach

    def at_home(own: Anchors, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= reach[own.width]

    least_score = {width: np.full(len(some.ids), UNKNOWN) for width, some in anchors.items()}

    def reachable(own: Anchors, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= least_score[own.width]

    def offers(own: Anchors, which: np.ndarray, scores: np.ndarray, same: np.ndarray, other: np.ndarray, best: Best) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        worst = np.where(best.worst()[which] == best.none, UNKNOWN, -best.worst()[which])
        yield *np.nonzero(same & (scores >= worst[:, None])), 0

    near = blocks.where(in_ranges(sorted({r.block for r in homes})[:LISTED]))
    for row in scored(near, anchors, at_home, 1, k, offers).where(F.col("rank") == k).select("width", "anchor", "score").collect():
        least_score[row.width][row.anchor] = row.score
    return scored(chosen_blocks(blocks, anchors, reachable), anchors, reachable, 1, k, offers)


def negatives_in_windows(blocks: DataFrame, anchors: dict[int, Anchors], positives: list, slots: int, k: int) -> DataFrame:
    """The first `k` rows of another label in the window below each positive."""
    spans = {width: (np.ones((len(some.ids), slots), np.int64), np.zeros((len(some.ids), slots), np.int64)) for width, some in anchors.items()}
    for row in positives:
        low, high = spans[row.width]
        low[row.anchor, row.rank - 1] = -(-LOWEST * row.score // 100)
        high[row.anchor, row.rank - 1] = HIGHEST * row.score // 100

    def crossed(own: Anchors, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = spans[own.width]
        return ((low <= high) & (least[:, None] <= high) & (most[:, None] >= low)).any(axis=1)

    def offers(own: Anchors, which: np.ndarray, scores: np.ndarray, same: np.ndarray, other: np.ndarray, best: Best) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        low, high = spans[own.width]
        for slot in range(slots):
            worst = best.worst()[which * slots + slot]
            least = np.maximum(low[which, slot], np.where(worst == best.none, UNKNOWN, -worst))
            yield *np.nonzero(other & (scores >= least[:, None]) & (scores <= high[which, slot][:, None])), slot

    return scored(chosen_blocks(blocks, anchors, crossed), anchors, crossed, slots, k, offers)


def hard_negatives(
    embeddings: DataFrame,
    asks: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Hard negatives of every row where `asks`: `anchor_id`, `positive_id`, `rank` from 1, `negative_id`, `positive_score`, `negative_score`.

    Entries become floor(256 x); a score is the inner product of such vectors, exact. An anchor's positives are
    its first `positives` other rows of its label, higher scores first, then smaller ids, rows without an id last
    of equals. Each positive's negatives are the first `negatives` rows of another label whose score is from 50 to
    95 hundredths of the positive's; positives without any (all of negative score) have no row.

    Rows with a null label, or a vector that is null, empty or has a null, NaN or infinite entry (or one of 65,536
    and more) take no part. Rows with the anchor's own id are none of its positives or negatives, rows without an
    id are no anchors, equal rows are one anchor; a repeated row is a positive or negative as often as it occurs.
    Only vectors of one width are compared.

    Anchors are taken in parts of `part_bytes`, each sent to the tasks that read the blocks.
    """
    spark = embeddings.sparkSession
    path, result = work_path(spark, "blocks"), work_path(spark, "negatives")
    write_blocks(on_grid(embeddings, id_col, vector_col, label_col), path, block_rows)
    blocks = spark.read.parquet(path)
    asked = on_grid(embeddings.where(asks), id_col, vector_col, label_col).where("id IS NOT NULL").select("id", "label", "width", "point").dropDuplicates()

    def mined(part: pa.Table) -> DataFrame:
        batches = part.combine_chunks().to_batches()
        anchors = {}
        for width in set(part.column("width").to_pylist()):
            anchors[width] = Anchors([b.filter(pa.array(b.column("width").to_numpy() == width)) for b in batches], width)
        first = best_positives(blocks, anchors, positives).collect()  # so many rows an anchor of the part
        found = negatives_in_windows(blocks, anchors, first, positives, negatives)
        pairs = spark.createDataFrame(
            [(r.width, r.anchor, r.rank - 1, int(anchors[r.width].ids[r.anchor]), r.id, r.score) for r in first],
            "width int, anchor long, slot int, anchor_id long, positive_id long, positive_score long",
        )
        found = found.join(F.broadcast(pairs), ["width", "anchor", "slot"])
        return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    parts = parts_of(asked, F.octet_length("point") + 24, ["id", "label", "point"], part_bytes)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if second is None:
        return mined(first)
    for part in itertools.chain((first, second), parts):
        mined(part).write.mode("append").parquet(result)
    return spark.read.parquet(result)

"""SimHash near-duplicates found through Golay codes.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. Every 23-bit word
has exactly one codeword of the binary Golay code within distance 3, and five more at
distance 4 if that one is at distance 3. Two words at most 2 bits apart have a codeword
within distance 4 of both, namely the one nearest to a word between them; of two words
1 bit apart, the nearest codeword of either is within distance 4 of the other.

If two fingerprints differ in at most 4 bits, then either one segment is equal and
another has at most 2 errors, or two segments have 1 error each. So the keys

* an equal segment with a codeword within 4 of another segment, and
* the nearest codeword of one segment with a codeword within 4 of another, either way

bring every such pair together: some 60 short keys a fingerprint. What shares a key is
compared bit by bit.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.llm.components import connected
from bytelayout.llm.rows import id_and_text, keyed_by_text, map_texts, one_of_each
from bytelayout.session import materialize

WORDS = 4
BITS = 4
SEED = 42
# Rows of one key that a task compares with each other; larger keys are dealt out in pairs of blocks.
BUCKET_ROWS = 4096
CHUNK_ROWS = 1 << 17

GENERATOR = 0b101011100011  # of the binary Golay code of length 23
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # shift and bits


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the hashes of all word shingles; 0 for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(token) + 1 for token in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(words, len(tokens)) - 1 :].tolist()
    first = starts[: len(last)].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), CHUNK_ROWS):
        spans = zip(first[at : at + CHUNK_ROWS], last[at : at + CHUNK_ROWS], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(last)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """`doc_id` and `fp` of every row; a null text has no words."""
    fields = [T.StructField("fp", T.LongType())]
    each = lambda: lambda texts: [[fingerprint(text, words, seed) for text in texts]]
    return map_texts(id_and_text(docs, id_col, text_col), fields, each)


def remainder(word: int) -> int:
    for at in range(22, 10, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - 11)
    return word


def golay() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of the three bytes of a word, and for a syndrome its 1 or 6 error patterns up to weight 4."""
    syndromes = [np.array([remainder(byte << shift & 0x7FFFFF) for byte in range(256)]) for shift in (0, 8, 16)]
    patterns = np.full((2048, 6), -1)
    filled = np.zeros(2048, int)
    bit = [remainder(1 << at) for at in range(23)]
    for weight in range(5):
        for places in itertools.combinations(range(23), weight):
            at = 0
            for place in places:
                at ^= bit[place]
            if weight < 4 or filled[at] < 6:
                patterns[at, filled[at]] = sum(1 << place for place in places)
                filled[at] += 1
    return syndromes, patterns


class Codewords:
    """Numbers (12 bits) of the codewords near segments; the nearest is in the first column."""

    def __init__(self) -> None:
        self.syndromes, self.patterns = golay()

    def near(self, segment: np.ndarray) -> np.ndarray:
        low, mid, high = self.syndromes
        syndrome = low[segment & 255] ^ mid[segment >> 8 & 255] ^ high[segment >> 16]
        errors = self.patterns[syndrome]
        return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and the place in `fps` of each."""
        bits = fps.view(np.uint64)
        segments = [(bits >> np.uint64(shift) & np.uint64((1 << size) - 1)).astype(np.int64) for shift, size in SEGMENTS]
        near = [self.near(segment) for segment in segments]
        keys, places = [], []

        def add(kind: int, first: np.ndarray, second: np.ndarray) -> None:
            ok = (first >= 0) & (second >= 0)
            keys.append((kind << 40 | first << 12 | second)[ok])
            places.append(np.nonzero(ok)[0])

        pairs = list(itertools.permutations(range(3), 2))
        for kind, (exact, other) in enumerate(pairs):
            add(kind, np.broadcast_to(segments[exact][:, None], near[other].shape), near[other])
        for kind, (one, two) in enumerate(itertools.combinations(range(3), 2), start=len(pairs)):
            add(kind, np.broadcast_to(near[one][:, :1], near[two].shape), near[two])
            add(kind, near[one][:, 1:], np.broadcast_to(near[two][:, :1], near[one][:, 1:].shape))
        return np.concatenate(keys), np.concatenate(places)


def keyed(distinct: DataFrame) -> DataFrame:
    """`key` and `fp`, a row for each key of a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codewords()
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            keys, places = code.keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[places])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the places `a` and `b` are linked: the smallest place reached."""
    while True:
        la, lb = labels[a], labels[b]
        open_now = la != lb
        if not open_now.any():
            return labels
        a, b, la, lb = a[open_now], b[open_now], la[open_now], lb[open_now]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (further := labels[labels]).tobytes() != labels.tobytes():
            labels = further


def chunk_links(group: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within groups; the rows of a group follow each other."""
    values, place = np.unique(fps, return_inverse=True)
    unsigned, labels = fps.view(np.uint64), np.arange(len(values))
    size = np.diff(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))))
    left = np.repeat(size - 1, size) - (np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting, live, shift = 0, np.flatnonzero(left > 0), 1
    while len(live):
        near = np.bitwise_count(unsigned[live] ^ unsigned[live + shift]) <= bits
        if near.any():
            found.append((place[live[near]], place[live[near] + shift]))
            waiting += int(near.sum())
            if waiting > 1 << 20:
                labels = merge(labels, *(np.concatenate(side) for side in zip(*found, strict=True)))
                found, waiting = [], 0
        shift += 1
        live = live[left[live] >= shift]
    if found:
        labels = merge(labels, *(np.concatenate(side) for side in zip(*found, strict=True)))
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[labels[linked]], values[linked]


def linked(rows: DataFrame, group: list[str], bits: int, bucket_rows: int | None) -> DataFrame:
    """`a`, `b`: links within groups. With `bucket_rows`, rows of larger groups are given back as `a`, null and `key`."""
    dealt = rows.repartition(*group).sortWithinPartitions(*group).select(F.xxhash64(*group).alias("g"), "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        too_large = None

        def answer(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
            empty = pa.nulls(len(a), pa.int64())
            arrays = [pa.array(a), empty if b is None else pa.array(b), empty if key is None else pa.array(key)]
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "key"])

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(name).to_numpy() for name in ("g", "key", "fp")]
                held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
                if too_large is None and len(held[0]) < CHUNK_ROWS:
                    continue
            if not len(held[0]):
                continue
            if too_large is not None:  # more rows of the group given back before
                end = int((held[0] != too_large).argmax()) if (held[0] != too_large).any() else len(held[0])
                if end:
                    yield answer(held[2][:end], None, held[1][:end])
                if end < len(held[0]):
                    too_large = None
                held = [part[end:] for part in held]
                if batch is not None and len(held[0]) < CHUNK_ROWS or not len(held[0]):
                    continue
            g, key, fp = held
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            sizes = np.diff(np.concatenate((edges, [len(g)])))
            whole = len(g) if batch is None else edges[-1]
            large = np.repeat(sizes > bucket_rows, sizes) if bucket_rows else np.zeros(len(g), bool)
            if batch is not None and bucket_rows and sizes[-1] > bucket_rows:
                whole, too_large = len(g), g[-1]
            back, ready = np.flatnonzero(large[:whole]), np.flatnonzero(~large[:whole])
            if len(back):
                yield answer(fp[back], None, key[back])
            if len(ready):
                yield answer(*chunk_links(g[ready], fp[ready], bits), None)
            held = [part[whole:] for part in held]

    return dealt.mapInArrow(run, "a long, b long, key long")


def all_links(distinct: DataFrame, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (`a`, `b`) that join the same fingerprints as all pairs at most `bits` (4 or fewer) apart.

    Within a key only a spanning forest is given out, so no group of near copies is
    written as pairs. Keys of more than `bucket_rows` rows are cut into blocks, and
    every two blocks are compared in a task of their own.
    """
    if bits > BITS:
        raise ValueError("the keys meet up to 4 different bits only")
    first = materialize(linked(keyed(distinct), ["key"], bits, bucket_rows))
    back = first.where("b IS NULL").select("key", F.col("a").alias("fp"))
    links = first.where("b IS NOT NULL").select("a", "b")
    blocks = back.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("n"))
    placed = back.join(blocks, "key").withColumn("s", F.pmod(F.xxhash64("fp"), F.col("n")))
    pairs = placed.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).select(
        "key", "fp", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi")
    )
    return links.union(linked(pairs, ["key", "lo", "hi"], bits, None).select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `fp` (long, its bits the fingerprint), `component_id`.

    Words are separated by blanks and ASCII control spaces, A-Z lower-cased; a text of
    fewer than `words` words is one shingle, one without words (or null) has fingerprint
    0, linked like any other. `component_id` is the smallest id reachable over
    fingerprints at most `bits` apart; null ids are never smallest, unless there is no
    other. Equal texts meet in one fingerprint and are never compared.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected(all_links(distinct, bits, bucket_rows)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(placed.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The row of `docs` with the smallest id (and text hash) of each component, with all its columns; of equal ones any."""
    keyed_docs, mark = keyed_by_text(docs, id_col, text_col)
    return one_of_each(docs, near_duplicates(keyed_docs, words=words, bits=bits), id_col, mark)

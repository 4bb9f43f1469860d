"""Stupid-backoff scores of documents under the n-grams of all documents.

Documents are dealt into blocks by a hash. The distinct n-grams of a block, with how
often each occurs in it, are sent to buckets by the n-gram's hash; a bucket adds up its
count table and answers every block with the counts it asked for; the answers join the
block again, where the scores of its words are summed per document. An n-gram that is
in every document costs its bucket one entry per block, not one per document. Rows
carry sorted keys and counts as packed arrays, so that rows are few and small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.llm.repeats import BASE, document_starts, mixed
from bytelayout.llm.rows import FOLD, as_bytes, id_and_text, id_field
from bytelayout.llm.suffixes import words8

ORDER = 2
MIN_COUNT = 2
BACKOFF = 0.4
# Bytes of text that make a block, and that make one more bucket.
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20

FOLD_TABLE = np.frombuffer(FOLD, np.uint8)
REQUEST = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()),
])
ANSWER = T.StructType([
    T.StructField("block", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("counts", T.BinaryType()),
])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of every text in order, and the number of words of each text."""
    raw, starts, ends = document_starts(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    folded = FOLD_TABLE[raw]
    word = folded != 0x20
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[starts[starts < len(raw)]] |= word[starts[starts < len(raw)]]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[ends[ends > 0] - 1] |= word[ends[ends > 0] - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    words, size = words8(folded, 8), last - first
    hashes = mixed(size.astype(np.uint64) + BASE)
    live, at = np.arange(len(first)), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        part = words[first[live] + at] >> (np.uint64(64) - left.astype(np.uint64) * np.uint64(8))
        hashes[live] = mixed((hashes[live] ^ part) * BASE)
        at += 8
        live = live[size[live] > at]
    return hashes, counts


def gram_keys(words: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each word, by n from 0; 0 where a document has too few words before it."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = [np.ones(len(words), np.uint64), np.maximum(words, np.uint64(2))]
    for n in range(2, order + 1):
        before = np.concatenate(([np.uint64(0)], keys[-1][:-1]))
        longer = np.maximum(mixed(before * BASE + words + np.uint64(n)), np.uint64(2))
        keys.append(np.where(place >= n - 1, longer, np.uint64(0)))
    return keys


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the key, so sorted keys are sorted by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Byte planes of the numbers, so that compression finds the planes that are nearly all zeros."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def known_keys(keys: list[np.ndarray]) -> np.ndarray:
    """All keys of a block: the empty n-gram once a word, then every n-gram."""
    joined = np.concatenate(keys)
    return joined[joined > 0]


def texts_of(table: pa.Table) -> list[bytes]:
    return as_bytes(table.column("text").combine_chunks())


def requests(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """For each block and bucket the sorted keys (as differences) and their counts in the block."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, counts = word_hashes(texts_of(table))
        keys = np.sort(known_keys(gram_keys(words, counts, order)))
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        number = np.diff(np.concatenate((new, [len(keys)]))).astype(np.uint32)
        keys = keys[new]
        cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        parts = [slice(cuts[at], cuts[at + 1]) for at in used]
        return pa.table(
            [
                pa.array(used.astype(np.int32)), pa.array([key[0].as_py()] * len(used), pa.int32()),
                pa.array([packed(np.diff(keys[part], prepend=np.uint64(0))) for part in parts], pa.binary()),
                pa.array([packed(number[part]) for part in parts], pa.binary()),
            ],
            REQUEST.names,
        )

    return blocks.groupBy("block").applyInArrow(run, REQUEST)


def answers(asked: DataFrame) -> DataFrame:
    """Counts over all blocks, in the order of each block's keys."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(data, np.uint64), dtype=np.uint64) for data in table.column("keys").to_pylist()]
        counts = [unpacked(data, np.uint32) for data in table.column("counts").to_pylist()]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(known)).astype(np.uint64)[place]
        ends = np.cumsum([len(part) for part in keys])
        replies = [packed(part) for part in np.split(total, ends[:-1])]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(replies, pa.binary())], ANSWER.names)

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def micro_logs(keys: list[np.ndarray], count_of: np.ndarray, place: list[np.ndarray], min_count: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Millionths of the log score of each word, and how often it backed off."""
    size = len(keys[0])
    logs, steps, open_now = np.zeros(size), np.zeros(size, np.int64), np.ones(size, bool)
    for n in range(len(keys) - 1, 0, -1):
        exists = keys[n] > 0
        count = np.where(exists, count_of[place[n]], 0).astype(float)
        # The context of an n-gram is the (n-1)-gram that ends one word before; of a word, the empty one.
        context = count_of[place[n - 1]].astype(float)
        if n > 1:
            context = np.concatenate(([1.0], context[:-1]))
        taken = open_now & exists & (count >= (min_count if n > 1 else 1))
        logs[taken] = np.log(count[taken] / context[taken])
        open_now &= ~taken
        steps[open_now & exists] += 1
    return np.rint((logs + steps * np.log(backoff)) * 1e6).astype(np.int64), steps


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT,
    backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_tokens`, `n_backoff`, `log_micro`.

    Tokens are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A word
    w after h, the up to `order - 1` words before it in its document, scores
    count(h w) / count(h) if `h w` occurs at least `min_count` times in all documents,
    else `backoff` times its score after h less its first word; without h it scores
    count(w) / number of tokens. `log_micro` sums the natural logarithms, each rounded to
    millionths, so that the sum does not depend on its order; `n_backoff` counts the
    steps back. A null or empty text has no tokens and sums of 0. Copies of a document
    count as often as they occur.
    """
    source = id_and_text(docs, id_col, text_col)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, buckets = total // block_bytes + 1, total // bucket_bytes + 1
    # Repeated rows of one id share a block only if they are the same in every split of the input.
    spread = F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 256))
    blocks = source.withColumn("block", F.pmod(spread, F.lit(n_blocks)).cast("int"))
    schema = T.StructType([
        id_field(source), T.StructField("n_tokens", T.LongType()), T.StructField("n_backoff", T.LongType()),
        T.StructField("log_micro", T.LongType()),
    ])

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        words, counts = word_hashes(texts_of(table))
        keys = gram_keys(words, counts, order)
        joined = np.concatenate(keys)
        # Position 0 of the counts stands for n-grams that do not exist.
        known, place = np.unique(np.concatenate(([np.uint64(0)], joined)), return_inverse=True)
        replies = replies.sort_by("bucket").column("counts").to_pylist()
        count_of = np.concatenate(([np.uint64(0)], *(unpacked(data, np.uint64) for data in replies)))
        if len(count_of) != len(known):
            raise ValueError("an answer of a block is missing")
        logs, steps = micro_logs(keys, count_of, np.split(place[1:], len(keys)), min_count, backoff)
        ends = np.cumsum(counts)
        sums = [np.concatenate(([0], np.cumsum(part))) for part in (steps, logs)]
        per_doc = [part[ends] - part[ends - counts] for part in sums]
        return pa.table([table.column("doc_id"), pa.array(counts), pa.array(per_doc[0]), pa.array(per_doc[1])], schema.names)

    asked = requests(blocks, order, buckets)
    return blocks.groupBy("block").cogroup(answers(asked).groupBy("block")).applyInArrow(run, schema)

"""Removal of byte strings that occurred before, by suffix arrays over shared contexts.

Every string of `length` bytes holds a gram that its own bytes select (the last one of
the smallest hash), so equal strings select equal grams at equal places: an *anchor*.
Anchors are far fewer than bytes. They are brought together by the gram's hash; those
whose whole context (all strings that could hold the gram there) is equal to an earlier
one are repeated as a whole. Only contexts that differ while the gram is shared are cut
out of the texts and sorted: in a suffix array over many contexts the equal strings are
neighbours with a common prefix of `length` bytes, and all but the earliest are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.llm.rows import as_bytes, id_and_text, id_field
from bytelayout.llm.suffixes import common_prefixes, sorted_suffixes, words8
from bytelayout.session import materialize

LENGTH = 100
GRAM = 32
# Windows that a task looks at together, and contexts it sorts together: both bound its memory.
STRIDE = 1 << 20
CONTEXTS = 1 << 14
# Contexts of one gram beyond which single strings are hashed and grouped instead.
HOT_CONTEXTS = 1 << 15
# Estimated bytes of per-document lists that may be broadcast; beyond it texts are shuffled to them.
BROADCAST_BYTES = 24 << 20

MIX = np.uint64(0xBF58476D1CE4E5B9)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64((1 << 22) - 1)  # bits of a position within a stride
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` (a power of two) bytes from each position."""
    hashes, base = raw.astype(np.uint64) + np.uint64(1), BASE
    size = 1
    while size < gram:
        hashes = hashes[: len(hashes) - size] * base + hashes[size:]
        with np.errstate(over="ignore"):
            base = base * base
        size *= 2
    return mixed(hashes)


def row_grams(table: np.ndarray) -> np.ndarray:
    """The same hash of grams given as rows of bytes."""
    powers = np.ones(table.shape[1], np.uint64)
    powers[:-1] = BASE
    powers = np.cumprod(powers[::-1])[::-1]
    return mixed(((table.astype(np.uint64) + np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64))


def select_anchors(raw: np.ndarray, inside: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that the windows with `inside` select."""
    width = length - gram + 1
    hashes = gram_hashes(raw, gram)
    size = len(hashes)
    place = np.arange(size, dtype=np.uint64)
    ranked = np.full(-(-size // width) * width, ~np.uint64(0))
    ranked[:size] = (hashes & ~PLACE) | (PLACE - place)
    table = ranked.reshape(-1, width)
    until = np.minimum.accumulate(table, axis=1).ravel()
    since = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(raw) - length + 1
    least = np.minimum(since[:windows], until[width - 1 : width - 1 + windows])[inside]
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    at = (PLACE - (least & PLACE)).astype(np.int64)
    return at, hashes[at]


def gathered(raw: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Bytes `first` to `first + size` of `raw`, one row each, zeros up to `width`."""
    at = np.arange(width)
    found = raw[np.minimum(first[:, None] + at, len(raw) - 1)]
    found[at >= size[:, None]] = 0
    return found


def row_hash(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes (a multiple of 8 of them) and a number."""
    state = mixed(seed.astype(np.uint64) + BASE)
    for word in np.ascontiguousarray(table).view("<u8").T:
        state = mixed(state ^ (word * BASE)) + word
    return mixed(state)


def document_starts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and the first and end byte of every document."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends[:-1])), ends


def anchors_of(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Document number, position in it, gram hash and context hash of every anchor."""
    raw, starts, ends = document_starts(texts)
    reach = length - gram
    change = np.zeros(len(raw) + 1, np.int8)
    large = ends - starts >= length
    np.add.at(change, starts[large], 1)
    np.add.at(change, ends[large] - length + 1, -1)
    inside = np.cumsum(change, dtype=np.int8)[:-1] > 0
    for at in range(0, len(raw), STRIDE):
        part = raw[at : at + STRIDE + length - 1]
        here = inside[at : at + len(part) - length + 1] if len(part) >= length else inside[:0]
        if not here.any():
            continue
        found, grams = select_anchors(part, here, length, gram)
        found += at
        doc = np.searchsorted(ends, found, side="right")
        first = np.maximum(found - reach, starts[doc])
        size = np.minimum(found + length, ends[doc]) - first
        width = -(-(reach + length) // 8) * 8
        shape = (found - first) * (1 << 16) + size
        contexts = np.concatenate([
            row_hash(gathered(raw, first[k : k + STRIDE // 64], size[k : k + STRIDE // 64], width), shape[k : k + STRIDE // 64])
            for k in range(0, len(found), STRIDE // 64)
        ])
        yield doc, found - starts[doc], grams, contexts


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """`anchor`, `context`, `doc_id`, `mark`, `at` (position), `copy`.

    Equal contexts of one batch are collapsed here: a later one is a `copy`, which needs no
    partner any more and gets an anchor of its own, so that a passage in every document
    sends one row a batch to its group.
    """
    schema = T.StructType([
        T.StructField("anchor", T.LongType()), T.StructField("context", T.LongType()), id_field(docs),
        T.StructField("mark", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("copy", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(
                pa.table([batch.column("doc_id"), batch.column("mark")], ["doc_id", "mark"]),
                [("doc_id", "ascending"), ("mark", "ascending")], null_placement="at_start",
            )
            batch = batch.take(order)  # so that the first of equal contexts is the earliest
            rank = ordered(batch)
            if (again := np.concatenate(([False], rank[1:] == rank[:-1]))).any():
                batch = batch.filter(pa.array(~again))
            marks = batch.column("mark").to_numpy()
            found = list(anchors_of(as_bytes(batch.column("text")), length, gram))
            if not found:
                continue
            doc, at, grams, contexts = (np.concatenate(part) for part in zip(*found, strict=True))
            fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))  # not met in two strides
            doc, at, grams, contexts = (part[fresh] for part in (doc, at, grams, contexts))
            mark = marks[doc]
            order = np.lexsort((contexts, grams))
            later = np.zeros(len(order), bool)
            later[order[1:]] = (grams[order[1:]] == grams[order[:-1]]) & (contexts[order[1:]] == contexts[order[:-1]])
            grams = np.where(later, mixed(grams ^ mixed(mark.view(np.uint64) + at.astype(np.uint64))), grams)
            ids = batch.column("doc_id").take(pa.array(doc))
            for k in range(0, len(doc), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[part].view(np.int64)), pa.array(contexts[part].view(np.int64)),
                        ids.slice(k, 1 << 16), pa.array(mark[part]), pa.array(at[part].astype(np.int32)), pa.array(later[part]),
                    ],
                    schema.names,
                )

    return docs.mapInArrow(run, schema)


def compared(anchors: DataFrame) -> DataFrame:
    """`anchor`, `doc_id`, `mark`, `at`, `copy`: copies of an earlier context, and the first ones of contexts that differ.

    Rows come sorted by gram and context and are looked at once, whatever a gram's number
    of rows. A gram that goes on beyond a batch counts as one with different contexts.
    """
    schema = T.StructType([anchors.schema[name] for name in ("anchor", "doc_id", "mark", "at", "copy")])
    rows = anchors.repartition("anchor").sortWithinPartitions("anchor", "context", "doc_id", "mark", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int] | None = None
        first: tuple[object, int, int] = (None, 0, -1)  # document and place of the first row of the last context
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, context, mark, at = (batch.column(name).to_numpy() for name in ("anchor", "context", "mark", "at"))
            copy = batch.column("copy").to_numpy(zero_copy_only=False)
            doc = batch.column("doc_id").dictionary_encode()
            code, names = doc.indices.fill_null(-1).to_numpy(), doc.dictionary
            same_gram = np.concatenate(([before is not None and before[0] == anchor[0]], anchor[1:] == anchor[:-1]))
            same = same_gram & np.concatenate(([before is not None and before[1] == context[0]], context[1:] == context[:-1]))
            # Rows of the same document and place as the first of their context are that row again.
            opener = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
            again = same & (opener >= 0) & (code == code[opener]) & (mark == mark[opener]) & (at == at[opener])
            for row in np.flatnonzero((opener < 0) & (mark == first[1]) & (at == first[2])).tolist():
                again[row] = (names[code[row]].as_py() if code[row] >= 0 else None) == first[0]
            group = np.cumsum(~same_gram)
            differ = np.bincount(group, weights=~same) > 1
            differ[group[0]] |= same_gram[0]  # it began in the batch before
            differ[-1] = True  # it may go on
            repeated = (same & ~again) | copy
            needed = ~same & ~copy & differ[group]
            before = int(anchor[-1]), int(context[-1])
            if (last := int(opener[-1])) >= 0:
                first = names[code[last]].as_py() if code[last] >= 0 else None, int(mark[last]), int(at[last])
            kept = pa.array(np.flatnonzero(repeated | needed))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name).take(kept) for name in ("anchor", "doc_id", "mark", "at")), pa.array(repeated).take(kept)],
                schema.names,
            )

    return rows.mapInArrow(run, schema)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((new[1:], [True]))]


def attach(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with the lists of their document: broadcast up to a checked size, else both are shuffled."""
    bytes_of = {"array<int>": 4, "array<struct<start:int,end:int>>": 32}
    sizes = [F.size(name) * bytes_of[kind] for name, kind in lists.dtypes if kind in bytes_of]
    size = lists.agg(F.sum(sum(sizes, F.lit(64)))).first()[0]
    right = lists.withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark")
    if (size or 0) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    on = docs["doc_id"].eqNullSafe(right["_id"]) & (docs["mark"] == right["_mark"])
    return docs.join(right, on, how).drop("_id", "_mark")


def context_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """`anchor`, `doc_id`, `mark`, `first` (byte of the document) and `bytes` of every needed context."""
    reach = length - gram
    schema = T.StructType([
        T.StructField("anchor", T.LongType()), id_field(docs), T.StructField("mark", T.LongType()),
        T.StructField("first", T.IntegerType()), T.StructField("bytes", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, needs = as_bytes(batch.column("text")), batch.column("needs")
            counts = pc.list_value_length(needs).to_numpy()
            at = needs.flatten().to_numpy()
            raw, starts, _ = document_starts(texts)
            row = np.repeat(np.arange(batch.num_rows), counts)
            first = np.maximum(at - reach, 0)
            for k in range(0, len(row), 1 << 13):
                part = slice(k, k + (1 << 13))
                spans = zip(row[part].tolist(), first[part].tolist(), (at[part] + length).tolist(), strict=True)
                one = pa.array(row[part])
                grams = row_grams(gathered(raw, starts[row[part]] + at[part], np.full(len(one), gram), gram))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams.view(np.int64)), batch.column("doc_id").take(one), batch.column("mark").take(one),
                        pa.array(first[part].astype(np.int32)), pa.array([texts[r][a:b] for r, a, b in spans], pa.binary()),
                    ],
                    schema.names,
                )

    return docs.select("doc_id", "mark", "text", "needs").mapInArrow(run, schema)


def ordered(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """A number for the document of each row, smaller for a smaller id (null first) and mark."""
    keys = pa.table([batch.column("doc_id"), batch.column("mark")], ["doc_id", "mark"])
    order = pc.sort_indices(keys, [("doc_id", "ascending"), ("mark", "ascending")], null_placement="at_start").to_numpy()
    code = keys.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()[order]
    mark = keys.column("mark").to_numpy()[order]
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (code[1:] != code[:-1]) | (mark[1:] != mark[:-1]))))
    return rank


def spans_batch(table: pa.Table, row: np.ndarray, start: np.ndarray, length: int, schema: T.StructType) -> pa.RecordBatch:
    """Spans of repeated strings that start at `start` in the documents of rows `row`."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] - start[:-1] > length)))[: len(row)]
    last = np.concatenate((new[1:], [True]))[: len(row)]
    kept = pa.array(row[new])
    return pa.RecordBatch.from_arrays(
        [
            table.column("doc_id").combine_chunks().take(kept), table.column("mark").combine_chunks().take(kept),
            pa.array(start[new].astype(np.int32)), pa.array((start[last] + length).astype(np.int32)),
        ],
        schema.names,
    )


def repeated_in(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of every string in the contexts that an earlier place of them has too."""
    texts = as_bytes(table.column("bytes").combine_chunks())
    raw, starts, ends = document_starts(texts)
    words = words8(raw, length + 8)
    suffixes = sorted_suffixes(raw, length, words)
    row = np.repeat(np.arange(len(texts)), ends - starts)
    suffixes = suffixes[suffixes + length <= ends[row[suffixes]]]
    if not len(suffixes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    equal = common_prefixes(suffixes, words, length) == length
    row = row[suffixes]
    start = suffixes - starts[row] + table.column("first").to_numpy()[row]
    place = (ordered(table)[row] << 32) | start
    runs = np.flatnonzero(~equal)
    least = np.repeat(np.minimum.reduceat(place, runs), np.diff(np.concatenate((runs, [len(place)]))))
    later = place > least
    return row[later], start[later]


def sorted_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (`doc_id`, `mark`, `start`, `end`) by a suffix array over whole groups of anchors."""
    schema = T.StructType([contexts.schema["doc_id"], contexts.schema["mark"], *SPAN.fields])
    rows = contexts.repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows > 1:
                row, start = repeated_in(table, length)
                if len(row):
                    yield spans_batch(table, row, start, length, schema)

        for batch in batches:
            held.append(batch)
            if sum(part.num_rows for part in held) >= CONTEXTS:
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1]))
                if whole:
                    yield from out(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def hashed_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """The same spans from a 128-bit hash of every string: for grams of very many contexts, whose group is too large to sort."""
    fields = [T.StructField(name, T.LongType()) for name in ("h1", "h2", "start")]
    schema = T.StructType([*fields, contexts.schema["doc_id"], contexts.schema["mark"]])
    width = -(-length // 8) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw, starts, ends = document_starts(as_bytes(part.column("bytes")))
                count = np.maximum(ends - starts - length + 1, 0)
                row = np.repeat(np.arange(len(starts)), count)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                if not len(row):
                    continue
                table = gathered(raw, starts[row] + offset, np.full(len(row), length), width)
                hashes = [row_hash(table, np.full(len(row), seed)).view(np.int64) for seed in (1, 2)]
                start = part.column("first").to_numpy()[row] + offset
                one = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[0]), pa.array(hashes[1]), pa.array(start), part.column("doc_id").take(one), part.column("mark").take(one)],
                    schema.names,
                )

    strings = contexts.mapInArrow(run, schema)
    place = F.struct("doc_id", "mark", "start")
    firsts = strings.groupBy("h1", "h2").agg(F.min(place).alias("least"))
    later = strings.join(firsts, ["h1", "h2"]).where(place > F.col("least"))
    start = F.col("start").cast("int")
    return later.select("doc_id", "mark", start.alias("start"), (start + length).alias("end")).distinct()


def merged_lists(rows: DataFrame, needs: bool) -> DataFrame:
    """One row a document: `spans` merged, and the `needs` as they are."""
    array = T.ArrayType(SPAN)
    need = T.ArrayType(T.StructType([T.StructField("anchor", T.LongType()), T.StructField("at", T.IntegerType())]))
    fields = [rows.schema["doc_id"], rows.schema["mark"], T.StructField("spans", array)]
    schema = T.StructType([*fields, T.StructField("needs", need)] if needs else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for row in range(batch.num_rows):
                start, end = (part.to_numpy() for part in batch.column("spans")[row].values.flatten())
                a, b = merged(start, end) if len(start) else (start, end)
                spans.append([{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("needs")] if needs else columns, schema.names)

    return rows.mapInArrow(run, schema)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS
) -> DataFrame:
    """`doc_id`, `mark` and `spans` (merged) of the documents that repeat something; see `remove_repeats`."""
    reach = length - gram
    sized = compared(anchor_rows(docs, length, gram))
    span = F.struct(F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), (F.col("at") + length).alias("end"))
    lists = sized.groupBy("doc_id", "mark").agg(
        F.collect_list(F.when(F.col("copy"), span)).alias("spans"),
        F.collect_list(F.when(~F.col("copy"), F.struct("anchor", "at"))).alias("needs"),
    )
    lists = materialize(merged_lists(lists, needs=True))

    # Positions only: a gram's hash is made again from the text.
    needed = lists.where(F.size("needs") > 0).select("doc_id", "mark", F.col("needs.at").alias("needs"))
    contexts = context_rows(attach(docs, needed, "inner"), length, gram)
    hot = materialize(
        lists.select(F.explode("needs.anchor").alias("anchor")).groupBy("anchor").count()
        .where(F.col("count") > hot_contexts).select("anchor")
    )
    if hot.isEmpty():
        sorted_spans = sorted_contexts(contexts, length)
    else:
        sorted_spans = sorted_contexts(contexts.join(hot, "anchor", "left_anti"), length).union(
            hashed_contexts(contexts.join(hot, "anchor", "left_semi"), length)
        )
    more = sorted_spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    known = lists.where(F.size("spans") > 0).select("doc_id", "mark", "spans")
    both = known.union(more).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return materialize(merged_lists(both, needs=False))


FIELDS = [
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)), T.StructField("kept", T.BinaryType()),
]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    hot_contexts: int = HOT_CONTEXTS,
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_bytes`, `n_removed`, `spans`, `kept` (the remaining bytes).

    Removed is every byte covered by a string of `length` bytes of the UTF-8 text that
    also starts earlier: in a document of a smaller id (null is smallest), or earlier in
    the same document. Documents that share an id, or have none, are told apart and ordered
    by a 64-bit hash of the text; rows that share id and text are one document. Strings are
    judged on the input and never reach over a document's end; a null text is empty. Cuts
    are between bytes, so `kept` may split a character. `length` must exceed `gram`, a
    power of two; texts may have up to 2 GB.
    """
    source = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    spans = repeated_spans(source, length, gram, hot_contexts)
    schema = T.StructType([id_field(source), *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed, kept = as_bytes(batch.column("text")), [], [], []
            for text, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
                at, parts = 0, []
                for span in spans or ():
                    parts.append(text[at : span["start"]])
                    at = span["end"]
                kept.append(b"".join([*parts, text[at:]]))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
            found = batch.column("spans")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), found, pa.array(kept, pa.binary())],
                schema.names,
            )

    empty = F.array().cast(T.ArrayType(SPAN))
    joined = attach(source, spans, "left").withColumn("spans", F.coalesce("spans", empty))
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)

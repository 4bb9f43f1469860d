"""Benchmark decontamination: one Aho-Corasick automaton over all test windows, each text scanned once."""

from __future__ import annotations

import functools
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.llm.rows import BROADCAST_ROWS, FOLD, held_by_worker, id_and_text, keep_where, map_texts, named, words_of
from bytelayout.plans.joins import join_small
from bytelayout.session import materialize

WINDOW = 10
# The automaton takes some hundred times its patterns' bytes in every Python worker.
PART_BYTES = 4 << 20

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
]

Items = tuple[tuple[str, bytes], ...]


def test_items(items: DataFrame, id_col: str, text_col: str, max_bytes: int | None) -> Items:
    """The test texts, on the driver because automata must be in every task; a limit of the caller is checked first."""
    texts = id_and_text(items, id_col, text_col).where("text IS NOT NULL")
    if max_bytes is not None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > max_bytes:
            raise ValueError(f"{size} bytes of test items, more than {max_bytes}")
    rows = texts.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").collect()
    return tuple(sorted((row[0], row[1].encode()) for row in rows))


def parts_of(items: Items, window: int, part_bytes: int) -> list[Items]:
    """The items in parts of about `part_bytes`; a longer one is cut into pieces that share `window` - 1 words."""
    if sum(len(text) for _, text in items) <= part_bytes:
        return [items]
    parts: list[list[tuple[str, bytes]]] = [[]]
    held = 0
    for item, text in items:
        words = words_of(text)
        at = 0
        while at == 0 or at + window <= len(words):
            end, size = at, 0
            while end < len(words) and (end - at < window or size + len(words[end]) < part_bytes):
                size += len(words[end]) + 1
                end += 1
            if parts[-1] and held + size > part_bytes:
                parts.append([])
                held = 0
            parts[-1].append((item, b" ".join(words[at:end])))
            held += size
            at = max(end - window + 1, 1)
            if end == len(words):
                break
    return [tuple(part) for part in parts]


def framed(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def automaton(items: Items, window: int) -> ahocorasick.Automaton | None:
    return held_by_worker(("contamination", items, window), lambda: made_automaton(items, window))


def made_automaton(items: Items, window: int) -> ahocorasick.Automaton | None:
    """All windows, framed by blanks; the value of one is (bytes, words, items it is in)."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            found.setdefault(framed(words[at : at + size]), (size, set()))[1].add(item)
    if not found:
        return None
    made = ahocorasick.Automaton()
    for pattern, (size, ids) in found.items():
        made.add_word(pattern.decode("latin-1"), (len(pattern), size, frozenset(ids)))
    made.make_automaton()
    return made


def matches(auto: ahocorasick.Automaton | None, text: bytes) -> tuple[bytes, list[tuple[int, int, frozenset[str]]]]:
    """The folded text and, for every window in it, its first byte, words and items."""
    folded = framed(text.translate(FOLD).split())
    if auto is None:
        return folded, []
    return folded, [
        (end + 1 - size, words, ids) for end, (size, words, ids) in auto.iter(folded.decode("latin-1"))
    ]


def hit_words(folded: bytes, found: list[tuple[int, int, frozenset[str]]]) -> np.ndarray:
    """For each word, whether it lies in a window."""
    blanks = np.flatnonzero(np.frombuffer(folded, np.uint8) == 0x20)
    first = np.searchsorted(blanks, np.array([start for start, _, _ in found]))
    step = np.zeros(len(blanks), np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + np.array([words for _, words, _ in found]), -1)
    return np.cumsum(step)[:-1] > 0


def spans_of(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as characters of the original text, the end excluded."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], np.frombuffer(text.translate(FOLD), np.uint8) != 0x20, [False]))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    edges = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before a byte
    return [
        {"start": int(a), "end": int(b)} for a, b in zip(chars[starts[first]], chars[ends[last]], strict=True)
    ]


RUNS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def part_hits(docs: DataFrame, parts: list[Items], window: int) -> DataFrame:
    """`mark` (digest of the text), `items` and `runs` of hit words, a row for each part and text with a hit.

    Each part is a pass of its own, written before the next starts, so that a worker holds one automaton.
    """
    source = docs.select(digest_of(F.col("text")).alias("doc_id"), "text")
    fields = [FIELDS[2], T.StructField("runs", T._parse_datatype_string(RUNS))]
    found = []
    for part in parts:

        def each(part: Items = part) -> Callable[[list[bytes]], list[list]]:
            auto = automaton(part, window)

            def batch(texts: list[bytes]) -> list[list]:
                columns: list[list] = [[], []]
                for text in texts:
                    folded, hits = matches(auto, text)
                    runs = []
                    if hits:
                        hit = hit_words(folded, hits)
                        edges = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
                        places = zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), spans_of(text, hit), strict=True)
                        runs = [{"first": int(a), "last": int(b), **span} for a, b, span in places]
                    columns[0].append(sorted(set().union(*(ids for _, _, ids in hits))))
                    columns[1].append(runs)
                return columns

            return batch

        rows = map_texts(source, fields, each).where("size(runs) > 0").dropDuplicates(["doc_id"])
        found.append(materialize(rows.withColumnRenamed("doc_id", "mark")))
    return functools.reduce(DataFrame.union, found)


def merged(runs: list | None) -> tuple[int, list[tuple[int, int]]]:
    """Number of words in any run, and the runs that are left as characters."""
    n, spans, reach = 0, [], -1
    for first, last, start, end in sorted(map(tuple, runs or [])):
        if first > reach:
            spans.append((start, end))
        elif last > reach:
            spans[-1] = (spans[-1][0], end)
        n += max(0, last - max(first, reach))
        reach = max(reach, last)
    return n, spans


def united(docs: DataFrame, parts: list[Items], window: int) -> DataFrame:
    """`find_contamination` over more than one part."""
    hits = part_hits(docs, parts, window).groupBy("mark").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs")
    )
    keyed = docs.select(F.struct("doc_id", digest_of(F.col("text")).alias("mark")).alias("doc_id"), "text")
    counted = map_texts(keyed, FIELDS[:1], lambda: lambda texts: [[len(words_of(text)) for text in texts]])
    counted = counted.select("doc_id.doc_id", "doc_id.mark", "n_words")
    rows = join_small(counted, hits, ["mark"], "left", spread_by=F.col("doc_id"), broadcast_bytes=1 << 20)
    schema = T.StructType([FIELDS[1], FIELDS[3]])
    rows = rows.withColumn("union", F.udf(merged, schema, useArrow=True)("runs"))
    return rows.select("doc_id", "n_words", "union.n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "union.spans")


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    max_item_bytes: int | None = None, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_words`, `n_hit`, `items`, `spans`.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A
    window is `window` consecutive words of a test item, or all its words if it has
    fewer; an item without words has none. A word inside any window of a document is
    hit. `items` are the ids (as text, sorted; a null id is the empty text) of the items
    whose windows occur, `spans` the runs of hit words in characters of the original text.
    Null and empty texts have no words; equal items or ids count once. Items beyond
    `part_bytes` are looked for in parts, a pass over the texts for each, since an
    automaton is in every task; items beyond `max_item_bytes`, if given, are refused.
    """
    parts = parts_of(test_items(items, item_id_col, item_text_col, max_item_bytes), window, part_bytes)
    if len(parts) > 1:
        return united(id_and_text(docs, id_col, text_col), parts, window)
    tests = parts[0]

    def each() -> Callable[[list[bytes]], list[list]]:
        auto = automaton(tests, window)

        def batch(texts: list[bytes]) -> list[list]:
            columns: list[list] = [[], [], [], []]
            for text in texts:
                folded, found = matches(auto, text)
                n_words = folded.count(b" ") - 1 if len(folded) > 2 else 0
                hit = hit_words(folded, found) if found else np.zeros(0, bool)
                items_hit = sorted(set().union(*(ids for _, _, ids in found)))
                row = (n_words, int(hit.sum()), items_hit, spans_of(text, hit) if found else [])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            return columns

        return batch

    return map_texts(id_and_text(docs, id_col, text_col), FIELDS, each)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, max_item_bytes: int | None = None, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The rows of `docs` in which no window of a test item occurs, with all their columns."""
    parts = parts_of(test_items(items, item_id_col, item_text_col, max_item_bytes), window, part_bytes)
    if len(parts) > 1:
        mark = digest_of(named(docs, text_col).cast("string"))
        hits = materialize(part_hits(docs.select(named(docs, text_col).cast("string").alias("text")), parts, window).select("mark").distinct())
        hits = hits.select(F.col("mark").alias("_mark"))
        if hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            hits = F.broadcast(hits)
        return docs.join(hits, mark == hits["_mark"], "left_anti")
    tests = parts[0]

    def each() -> Callable[[list[bytes]], list[bool]]:
        auto = automaton(tests, window)
        return lambda texts: [not matches(auto, text)[1] for text in texts]

    return keep_where(docs, text_col, each)

"""Near-duplicates by SimHash and Golay codes, verified and made complete by the Jaccard similarity of word shingles.

Every text is read once and leaves a row in a table: a hash of its set of shingles (the
node), the set itself as hashes of six bytes, its SimHash fingerprint, a sketch of 512
minima of a byte each, and 25 keys, each of six minima. Two sets of similarity s share a
key with probability 1 - (1 - s^6)^25: 0.9995 at 0.8, 0.88 at 0.66, 0.02 at 0.3.

First `simhash.all_links` finds fingerprints up to 4 bits apart through Golay codewords, and
what it links is verified. Fingerprints of two sets with a similarity of 0.8 differ in some
10 of 64 bits, though, so what this has not connected is looked for by the minima: nodes
that share a key are candidates, and only keys and nodes are shuffled for that. Sizes
and sketches then rule out most candidates: sizes exactly, sketches where fewer minima
are equal than at a similarity of 0.8 in all but one of 9,000 pairs. What is left is
verified on the sets themselves: first each node against the first one of its keys, then
what is not connected so far in blocks of a key, of which only a spanning forest of the
links found goes on.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.llm.components import FEW_LINKS, connected
from bytelayout.llm.rows import Scratch, id_and_text, keyed_by_text, map_texts, one_of_each
from bytelayout.llm.simhash import CHUNK_ROWS, all_links
from bytelayout.plans.joins import join_small
from bytelayout.session import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 6
MINIMA = 512
# Standard deviations that the number of equal minima may fall short of its mean at the similarity asked for.
SHORT = 3.7
HASH_BYTES = 6
SEED = 42
# Shingles whose minima are taken at a time; rows of a key that are compared in one task; bytes of sets that may be broadcast.
CHUNK = 256
LEFT_ROWS, RIGHT_ROWS = 1024, 4096
# Bands that are looked at one after another; what the earlier ones have connected is not compared again.
BAND_STEPS = (0, 1, 5, BANDS)
BROADCAST_BYTES = 32 << 20

_random = np.random.default_rng(SEED)
XORS = _random.integers(0, 1 << 32, MINIMA, np.uint32)[None, :]
FACTORS = _random.integers(0, 1 << 31, MINIMA, np.uint32)[None, :] << np.uint32(1) | np.uint32(1)
KEY_FACTORS = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of all word shingles; a text of fewer words is one, a text without words has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(token) + 1 for token in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[min(words, len(tokens)) - 1 :].tolist())], np.uint64))


def minima_of(found: np.ndarray) -> np.ndarray:
    """The least of the shingles' hashes under each of `MINIMA` permutations."""
    minima = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    short = found.astype(np.uint32)
    for at in range(0, len(short), CHUNK):
        mixed = short[at : at + CHUNK, None] ^ XORS
        mixed *= FACTORS
        np.minimum(minima, mixed.min(0), out=minima)
    return minima


def keys_of(minima: np.ndarray) -> list[int]:
    mixed = minima[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    mixed = ((mixed * KEY_FACTORS) ^ (mixed * KEY_FACTORS) >> np.uint64(29)).sum(1, dtype=np.uint64) * KEY_FACTORS[:, 0]
    return (mixed ^ mixed >> np.uint64(31)).view(np.int64).tolist()


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def fingerprint_of(found: np.ndarray) -> int:
    """SimHash of a set: the majority bits of its shingles' hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK_ROWS):
        octets = found[at : at + CHUNK_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big", signed=True)


def packed_set(found: np.ndarray) -> bytes:
    """The highest bytes of the sorted hashes."""
    return found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked_set(held: bytes) -> np.ndarray:
    rows = np.frombuffer(held, np.uint8).reshape(-1, HASH_BYTES)
    whole = np.zeros((len(rows), 8), np.uint8)
    whole[:, :HASH_BYTES] = rows
    return whole.reshape(-1).view(">u8").astype(np.uint64)


FACTS = [
    T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("sketch", T.BinaryType()), T.StructField("held", T.BinaryType()),
    T.StructField("fp", T.LongType()),
]


def facts_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """`doc_id`, `node`, `size` of the set, `keys`, `sketch`, `held`, the set, and `fp` of every row; no keys without shingles."""

    def each() -> Callable[[list[bytes]], list[list]]:
        def batch(texts: list[bytes]) -> list[list]:
            rows = []
            for text in texts:
                found = shingles(text, words)
                minima = minima_of(found)
                sketch = (minima * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                keys = keys_of(minima) if len(found) else []
                rows.append((node_of(found), len(found), keys, sketch.tobytes(), packed_set(found), fingerprint_of(found)))
            return [list(column) for column in zip(*rows, strict=True)] if rows else [[]] * len(FACTS)

        return batch

    return map_texts(id_and_text(docs, id_col, text_col), FACTS, each)


def least_equal(similarity: float) -> int:
    """How many equal minima a pair so similar has at least, but for one of some 9,000 pairs."""
    return math.floor(MINIMA * similarity - SHORT * math.sqrt(MINIMA * similarity * (1 - similarity)))


def alike_sizes(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9


def likely(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (`a`, `b`) that sizes and sketches do not rule out."""
    least = least_equal(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(-1, MINIMA) for name in ("a_sketch", "b_sketch"))
            sizes = [batch.column(name).to_numpy() for name in ("a_size", "b_size")]
            fine = alike_sizes(*sizes, similarity) & ((left == right).sum(1) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    sketches = held.select("node", "size", "sketch")
    joined = pairs
    for side in ("b", "a"):
        joined = joined.join(sketches.toDF(side, f"{side}_size", f"{side}_sketch"), side)
    return joined.select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def similar(left: np.ndarray, right: np.ndarray, similarity: float) -> bool:
    both = np.sort(np.concatenate((left, right)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (`a`, `b`) whose sets of shingles are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("a_held"), batch.column("b_held"), strict=True)
            keep = [similar(unpacked_set(left.as_buffer()), unpacked_set(right.as_buffer()), similarity) for left, right in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = held.select("node", "held")
    hubs = sets.toDF("b", "b_held").join(pairs.select("b").distinct(), "b", "left_semi")
    joined = pairs.join(sets.toDF("a", "a_held"), "a")
    joined = join_small(joined, hubs, ["b"], "inner", spread_by=F.col("a"), broadcast_bytes=BROADCAST_BYTES)
    return joined.select("a", "b", "a_held", "b_held").mapInArrow(run, "a long, b long")


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of different components, with `a_root` and `b_root`."""
    for side in ("a", "b"):
        pairs = join_small(pairs, roots.toDF(side, f"{side}_root"), [side], "left", ready=True).withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    return pairs.where("a_root <> b_root")


def forest_of(table: pa.Table, similarity: float) -> tuple[list[tuple[int, int]], int]:
    """Links between rows of the left and the right side that connect what has different roots, and the number of verified pairs."""
    least = least_equal(similarity)
    node, root, size = (table.column(name).to_numpy() for name in ("node", "root", "size"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, MINIMA)
    packed, sides = table.column("held").combine_chunks(), table.column("left").to_numpy()
    above: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}

    def top(at: int) -> int:
        while at in above:
            at = above[at]
        return at

    def set_of(at: int) -> np.ndarray:
        if at not in sets:
            sets[at] = unpacked_set(packed[at].as_buffer())
        return sets[at]

    b = np.flatnonzero(~sides)
    columns, links, tried = np.ascontiguousarray(sketch[b].T), [], 0
    for one in np.flatnonzero(sides).tolist():
        maybe = np.flatnonzero((root[b] != root[one]) & alike_sizes(size[b], size[one], similarity))
        if not len(maybe):
            continue
        equal = (columns[:, maybe] == sketch[one][:, None]).sum(0)
        fine = np.argsort(-equal, kind="stable")[: int((equal >= least).sum())]  # the likeliest first
        for other in b[maybe[fine]].tolist():
            mine, its = top(int(root[one])), top(int(root[other]))
            if mine != its:
                tried += 1
                if similar(set_of(one), set_of(other), similarity):
                    above[max(mine, its)] = min(mine, its)
                    links.append((int(node[one]), int(node[other])))
    return links, tried


def linked_within_keys(members: DataFrame, roots: DataFrame, held: DataFrame, similarity: float, scratch: Scratch, at: int) -> DataFrame:
    """Verified pairs (`a`, `b`) that connect the components of the nodes (`key`, `node`) that share a key.

    Of each key, the nodes outside its largest component are compared with all others. Both sides are
    dealt into blocks, and a task compares two blocks, so no key is held whole by one. A task gives fewer
    links than it has rows: no pair is verified whose ends are connected already.
    """
    labelled = join_small(members, roots, ["node"], "left", ready=True).withColumn("root", F.coalesce("root", "node"))
    counts = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    keys = keys.where(F.col("all") > F.col("most.n")).select("key", F.col("most.root").alias("major"), "all", (F.col("all") - F.col("most.n")).alias("others"))
    keys = scratch.keep(f"open{at}", keys)
    met = join_small(labelled, keys, ["key"], "inner", spread_by=F.col("node"), ready=True)
    blocks = lambda rows, size: F.ceil(F.col(rows) / size).cast("int")
    own = lambda rows, size: F.pmod(F.xxhash64("node"), blocks(rows, size)).cast("int")
    every = lambda rows, size: F.explode(F.sequence(F.lit(0), blocks(rows, size) - 1))
    left = met.where("root <> major").select("key", own("others", LEFT_ROWS).alias("i"), every("all", RIGHT_ROWS).alias("j"), "node", "root", F.lit(True).alias("left"))
    right = met.select("key", every("others", LEFT_ROWS).alias("i"), own("all", RIGHT_ROWS).alias("j"), "node", "root", F.lit(False).alias("left"))

    def compare(table: pa.Table) -> pa.Table:
        links, _ = forest_of(table, similarity)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = left.union(right).join(held.select("node", "size", "sketch", "held"), "node")
    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_prints(facts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of nodes (`a`, `b`) with fingerprints up to 4 bits apart, as many as connect all of them.

    Of equal fingerprints each node is paired with the smallest one, which stands for them in the other pairs.
    """
    prints = facts.where("size > 0").groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    prints = scratch.keep("prints", prints)
    links = scratch.keep("near prints", all_links(prints.select("fp")))
    pairs = links
    for side in ("a", "b"):
        pairs = join_small(prints.select(F.col("fp").alias(side), F.col("hub").alias(f"{side}_hub")), pairs, [side], "inner", ready=True)
    shared = prints.where("hub <> last").select("fp", "hub")
    equal = join_small(facts.select("node", "fp"), shared, ["fp"], "inner", spread_by=F.col("node"), ready=True).where("node <> hub")
    return pairs.select(F.col("b_hub").alias("a"), F.col("a_hub").alias("b")).union(equal.select("node", "hub").distinct())


def similar_roots(facts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """`node` and `root` of every node linked to another one. `facts` is not read any more when this returns.

    What the fingerprints link is verified first. Then each node is verified against the first node of one of its
    keys, then against those of the others, where they are not connected so far. What is in different components
    after that is compared within keys, some bands after another. No pair that shares a key is left out but those
    already in one component.
    """
    keep = scratch.keep
    near = keep("near", near_prints(facts, scratch))
    scratch.drop("prints", "near prints")
    each = facts.select("node", F.posexplode("keys").alias("band", "key"))
    keys = each.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    keys = keep("keys", keys.select("key", "first"))
    members = keep("members", join_small(each, keys, ["key"], "inner", spread_by=F.col("node"), ready=True).distinct())
    candidates = keep("candidates", members.select("node").union(near.select("a")).union(near.select("b")).distinct())
    rows = join_small(facts.select("node", "size", "sketch", "held"), candidates, ["node"], "left_semi", ready=True)
    held = keep("held", rows.groupBy("node").agg(F.max(F.struct("size", "sketch", "held")).alias("f")).select("node", "f.*"))
    scratch.drop("facts", "keys", "candidates")

    links = keep("links near", verified(keep("likely near", likely(near, held, similarity)), held, similarity))
    roots = keep("roots near", connected(links, FEW_LINKS))
    stars = members.where("node <> first").groupBy(F.col("node").alias("a"), F.col("first").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    stars = keep("stars", stars)
    best = keep("best", stars.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", "best.b"))
    apart = across(best, roots).select("a", "b")
    links = links.union(keep("links", verified(keep("likely", likely(apart, held, similarity)), held, similarity)))
    roots = keep("roots", connected(links, FEW_LINKS))
    others = across(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), roots).select("a", "b")
    links = links.union(keep("links more", verified(keep("likely more", likely(others, held, similarity)), held, similarity)))
    roots = keep("roots more", connected(links, FEW_LINKS))
    scratch.drop("near", "likely near", "roots near", "stars", "best", "likely", "likely more", "roots")

    for at, (start, end) in enumerate(itertools.pairwise(BAND_STEPS)):
        some = members.where((F.col("band") >= start) & (F.col("band") < end)).select("key", "node")
        links = links.union(keep(f"links{at}", linked_within_keys(some, roots, held, similarity, scratch, at)))
        roots = keep(f"roots{at}", connected(links, FEW_LINKS))
        scratch.drop(f"open{at}")
    scratch.drop("held", "members")
    return roots


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `node`, `component_id`.

    Words are separated by blanks and ASCII control spaces, A-Z lower-cased; a text of
    fewer than `words` words is one shingle, and texts without words (or null) are alike.
    Two texts are linked if the Jaccard similarity of their sets of shingles is at least
    `similarity`; `component_id` is the smallest id reachable over links, and null ids are
    never smallest, unless there is no other. `node` is a hash of the set of shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    facts = scratch.keep("facts", facts_of(docs, id_col, text_col, words))
    each = scratch.keep("each", facts.select("doc_id", "node"))
    roots = similar_roots(facts, similarity, scratch)
    nodes = each.groupBy("node").agg(F.min("doc_id").alias("low"))
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low")
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    found = materialize(each.join(placed.join(lows, "root").select("node", "component_id"), "node").select("doc_id", "node", "component_id"))
    scratch.drop()
    return found


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """The row of `docs` with the smallest id (and text hash) of each component, with all its columns; of equal ones any."""
    keyed_docs, mark = keyed_by_text(docs, id_col, text_col)
    return one_of_each(docs, similar_documents(keyed_docs, words=words, similarity=similarity), id_col, mark)

"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelayout.session import materialize

# Links that one task may connect by itself, some 16 bytes each; more are connected in rounds.
FEW_LINKS = 200_000


def connected(links: DataFrame, few: int = 0) -> DataFrame:
    """`node` and `root`, its smallest reachable node, for every node of a link (`a`, `b`) between two nodes.

    In turn every node points its larger neighbours, and then its smaller ones, to the
    smallest node it sees, until nothing changes: about log(nodes) rounds. Minima are
    aggregated before the shuffle, so a node of many links is no group of its own, and
    each round is cut off by a checkpoint. Up to `few` links between whole numbers
    are connected by one task instead, with the same result; `links`, then read
    twice, should be a table at hand.
    """
    if few and links.count() <= few:
        return links.select("a", "b").coalesce(1).mapInArrow(_at_once, "node long, root long")
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        edges = materialize(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 30))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Point every node to the smallest one known until nothing changes; a bounded number of links."""
    held = list(batches)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(batch.column(name).to_numpy() for batch in held)]) for name in ("a", "b"))
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while (differ := root[a] != root[b]).any():
        a, b = a[differ], b[differ]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    linked = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["node", "root"])

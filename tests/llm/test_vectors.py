"""Operators on embeddings against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelayout.llm import negatives, queries, vptree, whitening

NAN, INF = float("nan"), float("inf")
CLASHING = ("id", "vector", "query", "width", "rows", "point", "key", "tie", "block", "label2", "doc_id", "rank", "score", "a.b")
SCHEMA = "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{name}` int" for name in CLASHING)


def clustered(count, width, seed):
    """Unit vectors around a few centres, some of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    found = centres[rng.integers(0, 12, count)] + rng.normal(size=(count, width)) * 0.4
    found[count // 2 : count // 2 + count // 10] = found[0]
    return (found / np.linalg.norm(found, axis=1, keepdims=True)).astype(np.float32)


def rows_of(points, start=0, labels=10):
    return [(start + k, [float(c) for c in v], (start + k) * 7919 % 11 % labels) for k, v in enumerate(points)]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Ordinary rows, ties, repeated rows, rows without id, label or vector, bad entries, other widths, clashing names."""
    rows = rows_of(clustered(700, 16, 1))
    rows += [(None, rows[3][1], 1), (None, rows[3][1], 2), (None, None, None), (1000, None, 1), (1050, [], 1), (1100, [0.0] * 16, 2)]
    rows += [(1150, [NAN] + [0.5] * 15, 1), (1151, [INF] * 16, 1), (1200, [None] + [0.5] * 15, 1), (1250, [0.5] * 16, None)]
    rows += [(1300, [0.25, 0.5], 3), (1301, [0.5, 0.5], 3), (1302, [0.5, 0.25], 4), (100, rows[100][1], rows[100][2]), (1400, [1e30] + [0.0] * 15, 5)]
    rows += [(-50, rows[5][1], 3), (-100, rows[6][1], 4)]
    frame = spark.createDataFrame([(*row, *range(len(CLASHING))) for row in rows], SCHEMA).repartition(5)
    return frame, rows


def usable(rows):
    kept = [(i, v, label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, np.array(v, np.float32).astype(float), label) for i, v, label in kept]


def order(i):
    return (i is None, i or 0)


def plain_neighbours(rows, divisor, k):
    kept = [row for row in usable(rows) if row[1].any()]
    asked = {(i, v.tobytes()): v for i, v, _ in kept if i is not None and i % divisor == 0}
    found = []
    for (query, _), v in asked.items():
        near = [(float(vptree.distances(v[None], w[None])[0]), order(i), i) for i, w, _ in kept if len(w) == len(v) and i != query]
        found += [(query, rank, i, score) for rank, (score, _, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(found, key=repr)


def test_neighbours_equal_brute_force(spark, odd_vectors):
    frame, rows = odd_vectors
    expected = plain_neighbours(rows, 50, 7)
    for part_bytes in (1 << 20, 600):  # one part, and several
        found = vptree.nearest(frame, F.expr("vec_id % 50 = 0"), 7, factor=1.0, part_bytes=part_bytes)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert {row[0] for row in expected} >= {-100, -50, 0, 100, 1300, 1400} and not {row[0] for row in expected} & {1000, 1050, 1100, 1150, 1200}


def test_neighbours_of_many_small_shards_and_a_relaxed_factor(spark):
    points = clustered(6000, 12, 2)
    rows = rows_of(points)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    expected = plain_neighbours(rows, 100, 10)
    exact = vptree.nearest(frame, F.expr("vec_id % 100 = 0"), factor=1.0)
    assert sorted(map(tuple, exact.collect()), key=repr) == expected
    least = {(q, rank): score for q, rank, _, score in expected}
    found = vptree.nearest(frame, F.expr("vec_id % 100 = 0")).collect()
    assert len(found) == len(expected)
    assert sum(r.score <= least[r.query_id, 10] for r in found) >= 0.9 * len(found)


def test_a_relaxed_factor_compares_less():
    points = clustered(4000, 8, 3).astype(float)
    order, nodes = vptree.grow(points, 32)
    assert sorted(order) == list(range(4000)) and len(nodes) > 100
    points = points[order]
    compared = []
    for factor in (1.0, 2.0, 4.0):
        searcher = vptree.Searcher(np.arange(-200, 0), points[:200] + 0.001, 5, factor)
        count = [0]
        whole = searcher.compare

        def counted(asking, rows, *rest, count=count, whole=whole):
            count[0] += len(asking) * (rows.stop - rows.start)
            whole(asking, rows, *rest)

        searcher.compare = counted
        searcher.shard(np.arange(4000), np.zeros(4000, np.int8), points, nodes)
        compared.append(count[0] / (200 * 4000))
    assert compared[0] < 0.6 and compared[0] > compared[1] > compared[2]


def test_equal_and_overflowing_vectors(spark):
    rows = [(k, [0.5, 0.5], 0) for k in range(900)] + [(1000, [1e300, 1.0], 0), (1001, [-1e300, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = vptree.nearest(frame, F.expr("vec_id IN (500, 1000)"), 3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(500, k + 1, k, 0.0) for k in range(3)] + [(1000, k + 1, k, INF) for k in range(3)]


def plain_negatives(rows, divisor):
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in usable(rows) if label is not None and all(abs(c) < 65536 for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    anchors = {(i, tuple(x), label) for i, x, label in kept if i is not None and i % divisor == 0}
    found = []
    for anchor, x, label in anchors:
        others = [(-dot(x, y), order(i), i, other == label) for i, y, other in kept if len(y) == len(x) and i != anchor]
        others.sort(key=lambda o: o[:2])
        for score, _, positive, _ in [o for o in others if o[3]][:5]:
            hits = [(i, -s) for s, _, i, same in others if not same and 50 * -score <= 100 * -s <= 95 * -score]
            found += [(anchor, positive, rank, i, -score, s) for rank, (i, s) in enumerate(hits[:3], 1)]
    return sorted(found, key=repr)


def test_negatives_equal_brute_force(spark, odd_vectors):
    frame, rows = odd_vectors
    expected = plain_negatives(rows, 10)
    assert len(expected) > 500
    for block_rows, part_bytes in ((64, 1 << 20), (1024, 1 << 20), (32, 700)):
        found = negatives.hard_negatives(frame, F.expr("vec_id % 10 = 0"), block_rows=block_rows, part_bytes=part_bytes)
        assert sorted(map(tuple, found.collect()), key=repr) == expected


def test_scores_beyond_exact_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in v], k % 3) for k, v in enumerate(rng.integers(-60000, 60000, (300, 64)).astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = negatives.hard_negatives(frame, F.expr("vec_id % 20 = 0"), block_rows=50)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_negatives(rows, 20)


def test_zones_leave_out_blocks(spark, tmp_path):
    """Blocks along the curve are small boxes: an anchor's bounds leave most of them out."""
    rng = np.random.default_rng(7)
    points = [(np.cos(t), np.sin(t)) for t in rng.uniform(0, 2 * math.pi, 20000)]
    frame = spark.createDataFrame(rows_of(points), "vec_id long, embedding array<float>, label int").repartition(4)
    negatives.write_blocks(negatives.on_grid(frame, "vec_id", "embedding", "label"), f"{tmp_path}/blocks", 100)
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    assert blocks.agg(F.sum("rows")).first()[0] == 20000
    own = negatives.Anchors([frame.limit(1).selectExpr("vec_id AS id", "CAST(label AS long) AS label", "2 AS width").toArrow().to_batches()[0].append_column(
        "point", negatives.packed(np.array([[256, 0]], np.int32)))], 2)
    read = negatives.chosen_blocks(blocks, {2: own}, lambda anchors, least, most: most >= 0.99 * 65536)
    assert "GreaterThanOrEqual(block" in read._jdf.queryExecution().toString()
    assert 0 < read.count() < 0.2 * blocks.count()


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (4, 2), (5, 1)])
def test_the_curve_goes_from_cell_to_cell(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)), np.uint32)
    keys = negatives.along_curve(cells.T.copy(), bits)
    ranked = cells[np.lexsort(keys.T[::-1])].astype(int)
    assert (np.abs(np.diff(ranked, axis=0)).sum(1) == 1).all()


def test_whitening_equals_plain_eigenvectors(spark, odd_vectors):
    frame, rows = odd_vectors
    kept = [(i, v) for i, v, _ in usable(rows) if len(v) == 16 and np.abs(v).max() < 1e15]
    x = np.floor(1024 * np.array([v for _, v in kept])) + 100000
    n, mean = len(x), x.mean(0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    model = whitening.fit_whitening(frame)
    assert (model.n, model.width) == (n, 16)
    assert np.allclose(model.eigenvalues, values[::-1][:8], rtol=1e-12)
    assert np.allclose(np.abs((model.components * vectors[:, ::-1][:, :8]).sum(0)), 1, atol=1e-12)
    assert abs(model.explained()[0] - values[-1] / values.sum()) < 1e-12
    assert whitening.identity_error(frame, model) < 1e-9
    found = whitening.whiten(frame, model).collect()
    expected = {}
    sums = [int(s) for s in x.sum(0)]
    for (i, _), row in zip(kept, x.tolist(), strict=True):
        expected.setdefault(i, []).append(sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)))
    assert sorted(r.deviation for r in found) == sorted(d for ds in expected.values() for d in ds)
    assert all(r.deviation in expected[r.doc_id] for r in found)
    assert np.allclose(np.array([r.whitened for r in found]).std(0), 1)


def test_whitening_of_few_directions(spark):
    schema = "vec_id long, embedding array<double>"
    flat = spark.createDataFrame([(k, [float(k % 7), 2.0 * (k % 7), 5.0]) for k in range(50)], schema)
    model = whitening.fit_whitening(flat)
    assert len(model.eigenvalues) == 1 and model.explained() == pytest.approx([1.0])
    assert np.allclose(np.abs(model.components[:, 0]), np.array([1, 2, 0]) / math.sqrt(5))
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [3.0]), (2, [3.0]), (None, [3.0])]):
        frame = spark.createDataFrame(rows, schema)
        model = whitening.fit_whitening(frame)
        assert len(model.eigenvalues) == 0 and whitening.identity_error(frame, model) == 0.0
        assert [list(r.whitened) for r in whitening.whiten(frame, model).collect()] == [[] for _ in range(model.n)]


def test_deviations_are_exact_or_null(spark):
    rows = [(k, [float(2**50 + 4096 * k), 0.0]) for k in range(3)] + [(9, [1e15, -1e15])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(frame)
    grid = [[1024 * int(c) + 100000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*grid, strict=True)]
    assert list(model.sums) == sums
    exact = [sum((model.n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in grid]
    found = {r.doc_id: r.deviation for r in whitening.whiten(frame, model).collect()}
    assert found == {row[0]: value if value < 2**63 else None for row, value in zip(rows, exact, strict=True)}


def test_jacobi_handles_clustered_eigenvalues():
    rng = np.random.default_rng(1)
    basis, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    for spectrum in (np.r_[[5.0] * 3, np.linspace(1, 2, 37)], np.r_[np.ones(20), np.zeros(20)], np.logspace(0, -10, 40)):
        scatter = (basis * spectrum) @ basis.T
        values, vectors = whitening.principal((scatter + scatter.T) / 2)
        rank = len(values)
        assert np.allclose(values, np.sort(spectrum)[::-1][:rank], rtol=1e-9, atol=1e-13)
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-10) and (spectrum > 1e-13).sum() <= rank
        assert np.allclose((vectors * values) @ vectors.T, scatter, atol=1e-12)


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, columns in (
        ("op11_whitening", ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]),
        ("op12_neighbours", ["query_id", "rank", "vec_id", "score"]),
        ("op13_negatives", ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]),
    ):
        found = queries.QUERIES[name](spark, str(tmp_path))
        assert found.columns == columns and found.collect() == []

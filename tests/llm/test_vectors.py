"""Both searches against brute force."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from turnwise.llm import collision, covertree, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def rows_of(n=400, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[50:70] = x[50]  # exact copies
    return [(i, [float(np.float32(v)) for v in x[i]], 0) for i in range(n)]


ODD = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 12, 0), (9003, [None] + [1.0] * 11, 0), (9004, [math.nan] * 12, 0), (9020, [math.inf] * 12, 0), (None, [1.0] * 12, 0), (9040, [1.0, 2.0], 0)]


def brute(rows, score, zero_too):
    usable = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero_too or any(v))]
    usable = {(i, tuple(v)) for i, v in usable}
    out = {}
    for i, v in usable:
        if i % 20 == 0:
            near = sorted((-score(v, w), j) for j, w in usable if j != i and len(w) == len(v))[:20]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_exact_top_equals_brute_force(spark):
    rows = rows_of() + ODD + [rows_of()[7]]
    got = {}
    for r in covertree.exact_top(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = lambda v: [math.floor(64 * x) for x in v]
    expected = brute(rows, lambda v, w: sum(a * b for a, b in zip(whole(v), whole(w))), True)
    assert got == {k: v for k, v in expected.items() if v}


def test_very_large_components_are_exact(spark):
    rows = [(0, [1e9, 3.0], 0), (1, [1e9, 1.0], 0), (2, [1e9 - 64, 5.0], 0)]
    got = [(r.vec_id, r.score) for r in covertree.exact_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("rank").collect()]
    score = lambda v, w: min(2**63 - 1, sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w)))
    assert got == sorted(((i, score(rows[0][1], v)) for i, v, _ in rows[1:]), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("scaled", [False, True])
def test_approximate_recall_and_scores(spark, scaled):
    rows = rows_of(1500)
    if scaled:  # lengths differ: largest inner product isn't smallest angle
        rows = [(i, [x * (1 + i % 7) for x in v], l) for i, v, l in rows]
    rows += ODD
    expected = brute(rows, lambda v, w: sum(np.float64(a) * np.float64(b) for a, b in zip(v, w)), False)
    data = dict((i, v) for i, v, _ in rows if i is not None)
    hits = total = 0
    got = {}
    for r in collision.approximate_neighbours(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, len(found) + 1))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        for r in found:
            exact = 0.0
            for a, b in zip(data[q], data[r.vec_id]):
                exact += float(np.float32(a)) * float(np.float32(b))
            assert r.score == pytest.approx(exact, rel=1e-12, abs=1e-12)
        least = expected[q][-1][1] - 1e-9
        hits += sum(r.score >= least for r in found)
        total += len(expected[q])
    assert hits / total >= 0.9


def test_empty_and_tiny(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert collision.approximate_neighbours(empty).count() == covertree.exact_top(empty).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (1, [0.5, 0.0], 0)], VECTORS)
    assert [(r.query_id, r.rank, r.vec_id) for r in collision.approximate_neighbours(two).collect()] == [(0, 1, 1)]
    assert [(r.vec_id, r.score) for r in covertree.exact_top(two).collect()] == [(1, 64 * 32)]


def test_tree_covers():
    x = np.floor(np.random.default_rng(5).standard_normal((500, 8)) * 10)
    tree = covertree.Tree(x)
    below = tree.below()
    assert sorted(below[0]) == list(range(500))
    for node, rows in enumerate(below):
        gap = np.sqrt(((x[rows] - x[tree.centre[node]]) ** 2).sum(axis=1))
        assert gap.max() <= tree.radius[node] + 1e-9
        if tree.children[node] is not None:  # children cover the node, and their centres lie apart
            assert sorted(np.concatenate([below[c] for c in tree.children[node]])) == sorted(rows)
            centres = x[tree.centre[tree.children[node]]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(centres))
            assert apart.min() > tree.radius[node] * covertree.SHRINK - 1e-9


def block(clusters, n=4096, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) if not clusters else rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.1 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def shares(x, kernel, k=20, floors=False):
    """(share of pairs whose inner product was computed, recall) of one block."""
    ids = np.arange(len(x))
    asks = ids[ids % 20 == 0]
    true = x[asks] @ x.T
    true[asks[:, None] == ids] = -np.inf
    kth = -np.sort(-true, axis=1)[:, k - 1]
    counted = []
    at, of, score = kernel(ids, x, asks, x[asks], kth - 1e-9 if floors else np.full(len(asks), -np.inf), k, counted)
    return sum(counted) / (len(x) * len(asks)), (score >= kth[at] - 1e-9).sum() / (k * len(asks))


def test_collisions_verify_few_rows_of_clusters():
    kernel = lambda *a: collision.nearest(*a[:-1], verified=a[-1])
    for floors in (False, True):
        share, recall = shares(block(40), kernel, floors=floors)
        assert share < 0.1 and recall >= 0.95
        share, recall = shares(block(0), kernel, floors=floors)  # no clusters: little can be left out
        assert share < 0.8 and recall >= 0.95


def test_trees_prune_clusters():
    whole = np.floor(block(40) * 64)
    for floors in (False, True):
        share, recall = shares(whole, covertree.top, floors=floors)
        assert share < 0.3 and recall == 1


def test_upper_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (1e-6, 1.0, 1e6):
        x, q = scale * rng.standard_normal((300, 6)), rng.standard_normal((40, 6))
        c = x[0]
        radius, largest = np.sqrt(((x - c) ** 2).sum(axis=1)).max(), np.sqrt((x * x).sum(axis=1)).max()
        bound = vectors.upper(q @ c, np.sqrt((q * q).sum(axis=1)), np.sqrt(c @ c), radius, largest)
        assert ((q @ x.T).max(axis=1) <= bound).all()


def test_many_cells_and_blocks_change_nothing(spark, monkeypatch):
    """Cells of a few rows, blocks of fewer, several chunks of queries; a third of all rows in one cell."""
    rows = [(i, [float(v) for v in np.float32(x)], 0) for i, x in enumerate(block(6, n=900, dim=8))]
    rows += [(2000 + i, rows[7][1][:-1] + [rows[7][1][-1] + i * 1e-4], 0) for i in range(450)]
    whole = lambda v: [math.floor(64 * x) for x in v]
    expected = brute(rows, lambda v, w: sum(a * b for a, b in zip(whole(v), whole(w))), True)
    for name, value in (("CELL", 100), ("ROW_BLOCK", 60), ("QUERY_BLOCK", 8), ("SAMPLE", 200)):
        monkeypatch.setattr(vectors, name, value)
    got = {}
    for r in covertree.exact_top(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == expected


def test_other_columns_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (1, [0.25, 0.0], 0), (2, [0.0, 1.0], 0)]
    clash = spark.createDataFrame(rows, VECTORS)
    for name in ("v", "dim", "cell", "block", "score", "rank", "query_id", "floor"):
        clash = clash.withColumn(name, F.lit("clash"))
    for search in (covertree.exact_top, collision.approximate_neighbours):
        got = search(clash).orderBy("rank").collect()
        assert got[0].__fields__ == ["query_id", "rank", "vec_id", "score"]
        assert [r.vec_id for r in got] == [1, 1, 2]

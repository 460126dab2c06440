"""Curves against brute force, and what takes no part."""

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import hilbert


def table(spark, v):
    return spark.createDataFrame([(i, [float(y) for y in x], 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")


def recall(spark, v, how, step=20):
    got = {}
    for r in hilbert.nearest(spark, table(spark, v), F.col("vec_id") % step == 0, how=how).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v, hits = np.asarray(v, np.float32).astype(float), 0
    q = range(0, len(v), step)
    for i in q:
        s = v @ v[i]
        s[i] = -np.inf
        rows = sorted(got[i])
        assert [x[0] for x in rows] == list(range(1, 21)) and all(abs(x[2] - s[x[1]]) < 1e-12 for x in rows)
        hits += len(set(np.argsort(-s)[:20]) & {x[1] for x in rows})
    return hits / len(q) / 20


def test_recall_on_clusters_with_narrow_windows(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    v = centres[rng.integers(0, 20, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    assert recall(spark, v / np.linalg.norm(v, axis=1, keepdims=True), hilbert.Curves(window=900, run=128)) >= 0.9


def test_recall_without_structure_needs_wide_windows(spark):
    v = np.random.default_rng(1).normal(size=(1500, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert recall(spark, v, hilbert.Curves(window=480, run=64)) >= 0.9  # a third of all in each order
    assert recall(spark, v, hilbert.Curves()) == 1.0


def test_windows_grow_until_a_sample_reaches_the_recall(spark):
    v = np.random.default_rng(2).normal(size=(2400, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert recall(spark, v, hilbert.Curves(window=64, run=32)) >= 0.9  # no structure: all are compared
    rng = np.random.default_rng(3)
    c = rng.normal(size=(12, 16))
    c = c[rng.integers(0, 12, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    assert recall(spark, c / np.linalg.norm(c, axis=1, keepdims=True), hilbert.Curves(window=32, run=16)) >= 0.9


def test_curve_visits_every_cell_next_to_the_last():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert len(set(keys.tolist())) == 512 and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0]), (100, [float("inf"), 1.0]), (120, [1.0, None]), (None, [1.0, 1.0]), (3, [0.5, 0.5]), (2, [0.5, 0.5]), (1, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 rank", "2 score")
    got = [tuple(r) for r in hilbert.nearest(spark, df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 0.5), (0, 2, 3, 0.5), (0, 3, 1, -1.0)]
    assert hilbert.nearest(spark, df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


def test_many_equal_vectors_and_repeated_ids(spark):
    v = [[1.0, 0.0]] * 400 + [[0.1 * (i % 3), 1.0] for i in range(30)]
    got = {}
    for r in hilbert.nearest(spark, table(spark, v), F.col("vec_id") % 20 == 0, how=hilbert.Curves(window=64, run=32)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [i for _, i in sorted(got[300])] == list(range(20)) and [i for _, i in sorted(got[0])] == list(range(1, 21))
    df = table(spark, [[1.0, 0.0], [0.5, 0.0], [0.4, 1.0]])
    twice = [(r.query_id, r.vec_id) for r in hilbert.nearest(spark, df.unionByName(df), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert twice == [(0, 1), (0, 2)]


def test_whole_number_scores_tie_by_id(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-1, 2, (900, 12)).astype(float)
    v[~v.any(axis=1)] = 1
    got = {}
    for r in hilbert.nearest(spark, table(spark, v), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, rows in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        assert [i for _, i in sorted(rows)] == np.lexsort((np.arange(900), -s))[:20].tolist()

"""Nearest vectors by inverted lists against all cosines."""

import numpy as np

from factweave.operators import vectorlists


def plain(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    s = np.round(x @ x.T, 12)
    return {(i, rank + 1): (ids[j], round(float(s[a, j]), 9)) for a, i in enumerate(ids) for rank, j in enumerate(sorted(range(len(ids)), key=lambda j: (-s[a, j], ids[j] != i, ids[j]))[:k])}


def test_equal_to_all_cosines(spark):
    """Clusters, copies of one vector in plenty, zeros, opposite directions; small rings, most of which are skipped."""
    r = np.random.default_rng(3)
    heads = r.normal(size=(12, 16))
    vectors = [heads[k % 12] + 0.05 * r.normal(size=16) for k in range(400)] + [heads[0]] * 30 + [-heads[1], 2 * heads[1], np.zeros(16)]
    rows = [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (9999, None), (9998, [])], "id long, embedding array<float>")
    got, skipped = vectorlists.knn_lists(df, 4, block=16)
    found = {(x.id, x.rank): (x.other, round(x.similarity, 9)) for x in got.collect()}
    want = plain(rows, 4)
    zero = len(rows) - 1
    assert {x: v for x, v in found.items() if x[0] != zero and v[1] > 0.01} == {x: v for x, v in want.items() if x[0] != zero and v[1] > 0.01}
    assert skipped > 0.5
    near, _ = vectorlists.knn_lists(df, 4, 0.9)
    assert {(x.id, x.rank) for x in near.collect()} == {x for x, v in want.items() if v[1] >= 0.9}


def test_no_vectors(spark):
    got, skipped = vectorlists.knn_lists(spark.createDataFrame([(1, None)], "id long, embedding array<float>"), 3)
    assert got.count() == 0 and skipped == 0.0


def test_rings_go_to_cells(spark, monkeypatch):
    """vectors without clusters, of which each ring meets most others, in several cells; a cell gives the best of a vector once."""
    monkeypatch.setattr(vectorlists, "CELL", 8 * 100)
    r = np.random.default_rng(5)
    rows = [(k, [float(np.float32(v)) for v in r.normal(size=8)]) for k in range(500)]
    got, _ = vectorlists.knn_lists(spark.createDataFrame(rows, "id long, embedding array<float>"), 4, block=16)
    assert {(x.id, x.rank): (x.other, round(x.similarity, 9)) for x in got.collect()} == plain(rows, 4)
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().optimizedPlan().toString()

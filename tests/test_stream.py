"""Many queries at once, against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from vectide.functions.distance import distances
from vectide.operators import search, stream


def made(n, seed, dim=6):
    """Vectors of which many are alike, one is zero, one large and one tiny."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype(np.float32)[rng.integers(0, n // 2, n)]
    m[n // 2], m[n // 3], m[n // 4] = 0, m[0] * 1e6, m[0] * 1e-6
    return m


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("shift", [0, 30])
def test_nearest_of_a_block(monkeypatch, metric, shift):
    monkeypatch.setattr(stream, "TILE", 16)
    monkeypatch.setattr(stream, "PAIRS", 50)
    v, q = made(400, 1) + np.float32(shift), made(40, 2) + np.float32(shift)
    q[:9] = v[:9]
    order = np.random.default_rng(4).permutation(400)
    for k in (1, 7, 400):
        near = stream.Nearest(q, k, metric)
        for lo in range(0, 400, 37):
            near.meet(np.arange(40), v[lo : lo + 37], order[lo : lo + 37], pa.array([f"r{x:03}" for x in order[lo : lo + 37]]))
            near._forget()
        one, ids, d = near.found(np.arange(40))
        assert len(ids) == 40 * k
        exact = distances(v, q, metric)
        for j in range(40):
            mine = [int(x.as_py()[1:]) for x in ids.take(pa.array(np.flatnonzero(one == j)))]
            at = np.argsort(order)[mine]
            assert len(set(mine)) == k and np.allclose(exact[at, j], np.sort(exact[:, j])[:k], rtol=1e-9, atol=1e-5 if metric == "dot" else 1e-6)
            got = d[one == j]
            assert (np.diff(got) >= 0).all() and all(a < b for a, b, same in zip(mine, mine[1:], np.diff(got) == 0, strict=False) if same)


def test_distances_that_are_no_numbers_come_last():
    v = np.ones((5, 2), np.float32)
    v[1] = np.nan
    near = stream.Nearest(np.array([[1, 1], [np.nan, 0]], np.float32), 5, "cosine")
    near.meet(np.arange(2), v, np.arange(5), pa.array(range(5)))
    one, ids, d = near.found(np.arange(2))
    assert ids.to_pylist() == [0, 2, 3, 4, 1, 0, 1, 2, 3, 4] and np.isnan(d).tolist() == [False] * 4 + [True] * 6


def test_many_queries_do_not_go_through_the_driver(spark, monkeypatch):
    m = made(300, 7)
    rows = spark.createDataFrame([(f"r{i:03}", v.tolist()) for i, v in enumerate(m)] + [("none", None)], "id string, vector array<float>")
    queries = spark.createDataFrame([(f"q{i:03}", v.tolist()) for i, v in enumerate(m)] + [("none", None)], "query_id string, query array<float>")

    def refused(self):
        raise AssertionError("gathered")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(stream, "CHUNK", 50)
    got = {(r.query_id, r["rank"]): (r.score, r.id) for r in search.batch_nearest(rows, queries, 5).collect()}
    d = np.clip(distances(m, m, "cosine"), 0, 2)
    assert len(got) == 1500
    for j in range(300):
        mine = [got[f"q{j:03}", k] for k in range(1, 6)]
        assert mine == sorted(mine) and np.allclose([s for s, _ in mine], np.sort(d[:, j])[:5], atol=1e-9)
        same = [f"r{i:03}" for i in range(300) if (m[i] == m[j]).all()]
        if j != 150 and len(same) > 5:
            assert [i for _, i in mine][:1] <= same[:1]

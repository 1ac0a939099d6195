"""Approximate search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide import Database
from vectide.functions.distance import distances
from vectide.operators import ann
from vectide.plans import queries

SF = "/root/testdata/sf0.001"


def made(spark, n, seed=5, dim=8):
    """n vectors about 40 centres; the last thirty are copies of the first."""
    rng = np.random.default_rng(seed)
    m = (rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.3).astype(np.float32)
    m[-30:] = m[0]
    return m, spark.createDataFrame([(f"r{k:05}", v.tolist()) for k, v in enumerate(m)], "id string, vector array<float>")


def test_recall_of_every_vector(spark):
    got = queries.QUERIES["knn_label_recall"](spark, SF).collect()
    assert {r.query_id for r in got} == {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert np.mean([r.recall for r in got]) >= 0.9


@pytest.mark.parametrize("block", [20_000, 37])
def test_batches_find_what_single_searches_find(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    m, rows = made(spark, 900)
    for metric in ("cosine", "euclidean", "dot"):
        path = f"file://{tmp_path}/{metric}"
        ann.AnnIndex.write(rows.union(spark.createDataFrame([("none", None)], rows.schema)), path, metric)
        index = ann.AnnIndex.open(spark, path)
        asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m[:60])] + [(-1, None)], "query_id int, query array<float>")
        got = index.batch_search(asked, 7).collect()
        d = distances(m, m[:60], metric)
        assert len(got) == 60 * 7 and all(abs(d[int(r.id[1:]), r.query_id] - r.score) < 1e-6 for r in got)
        whole = index.batch_search(asked, 7, probes=len(index.centroids)).collect()
        ranked = {(r.query_id, r["rank"]): r.score for r in whole}
        assert len(ranked) == len(whole) == 60 * 7
        assert all(abs(ranked[j, k + 1] - np.sort(d[:, j])[k]) < 1e-6 for j in range(60) for k in range(7))
        assert [r.id for r in index.batch_search(asked.where("query_id = 3"), 7).orderBy("rank").collect()] == [r.id for r in index.search(m[3].tolist(), 8).where("id <> 'none'").limit(7).collect()]
    assert index.batch_search(asked, 0).collect() == [] and index.batch_search(asked.where("query_id > 99"), 3).collect() == []


def test_collections_keep_recall_whatever_top_k_is(spark, monkeypatch):
    monkeypatch.setattr(ann, "EXACT_BELOW", 1000)
    m, rows = made(spark, 3000)
    rows = rows.withColumn("metadata", F.to_json(F.struct((F.substring("id", 2, 9).cast("int") % 3).alias("third"))))
    db = Database(spark=spark)
    near, flat = (db.create_collection(name, 8, "euclidean", name) for name in ("hnsw", "flat"))
    for c in (near, flat):
        c.upsert_df(rows)
    assert near._index() is not None and len(near._index().centroids) == 54
    d = distances(m, m[:3], "euclidean")
    for q in range(3):
        for k in (10, 100, 1000, 4000):
            got = near.query(m[q].tolist(), k)
            assert len(got) == min(k, 3000)
            edge = np.sort(d[:, q])[len(got) - 1]
            assert np.mean([r["score"] <= edge + 1e-6 for r in got]) >= 0.9
        for k in (10, 100):
            some = [{r["id"] for r in c.query(m[q].tolist(), k, {"third": 1})} for c in (near, flat)]
            assert len(some[0]) == len(some[1]) == k and len(some[0] & some[1]) >= 0.9 * k


def test_batches_read_the_same_cells_by_part_of_the_order():
    rng = np.random.default_rng(3)
    q, centroids, sizes = rng.normal(size=(50, 8)), rng.normal(size=(90, 8)), rng.integers(0, 9, 90)
    for least in ((3, 14), (20, 0), (3, 200), (90, 0)):
        whole, part = ann._by_nearness(q, centroids, "euclidean"), ann._by_nearness(q, centroids, "euclidean", sizes, *least)
        reach = ann._reach(whole, sizes, *least)
        assert (reach == ann._reach(part, sizes, *least)).all()
        assert all((whole[i, : reach[i]] == part[i, : reach[i]]).all() for i in range(50))


def test_what_batches_find_is_not_shuffled_by_cells(spark, tmp_path):
    m, rows = made(spark, 900)
    path = f"file://{tmp_path}/index"
    ann.AnnIndex.write(rows, path, "cosine")
    found = ann.AnnIndex.open(spark, path).batch_search(rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 7)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 6300

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.errors import DimensionMismatch, StorageError
from vectide.operators import ann, bm25, fusion, merge, search
from vectide.sources import changelog, vectorfile


def test_change_log(spark, tmp_path):
    log = changelog.ChangeLog(spark, f"file://{tmp_path}/log")
    assert log.entry_count() == 0 and log.replay() == []
    log.append("Upsert", {"id": "old", "v": 1.5})
    log.append("Delete", {"id": "x"})
    assert log.entry_count() == 2 and log.replay() == [{"Upsert": {"id": "old", "v": 1.5}}, {"Delete": {"id": "x"}}]
    log.checkpoint()
    assert log.entry_count() == 0 and log.replay() == []


@pytest.mark.parametrize("lines, kept", [
    (['{"Upsert":{"id":"old"}}', '"Checkpoint"', '{"Upsert":{"id":"new"}}'], ["new"]),
    (['{"Upsert":{"id":"good"}}', "{broken", '{"Upsert":{"id":"late"}}'], ["good"]),
    (['{"Upsert":{"id":"a"}}', "", "{broken", '"Checkpoint"'], ["a"]),
    ([], []),
])
def test_replay(spark, tmp_path, lines, kept):
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    got = changelog.replay(spark, str(tmp_path / "log")).orderBy("pos").select(F.variant_get("body", "$.id", "string")).collect()
    assert [r[0] for r in got] == kept


def test_vector_files(spark, tmp_path):
    path = str(tmp_path / "vectors.bin")
    m = np.arange(12_000 * 8, dtype=np.float32).reshape(12_000, 8)
    vectorfile.write_vectors(path, m)
    assert vectorfile.append_vectors(path, m[:2] + 1) == [12_000, 12_001]
    assert vectorfile.get_vector(path, 12_001) == (m[1] + 1).tolist() and vectorfile.get_vector(path, 12_002) is None
    got = vectorfile.read_vectors(spark, path)
    assert got.count() == 12_002 and got.where("idx = 11999").first()["vector"] == m[-1].tolist()
    with pytest.raises(DimensionMismatch):
        vectorfile.append_vectors(path, np.zeros((1, 3)))
    for bad in (b"", b"x" * 16, vectorfile.MARK + (4).to_bytes(4, "little") * 2 + bytes(4)):
        with pytest.raises(StorageError):
            vectorfile.parse_header(bad)
    with sqlite3.connect(tmp_path / "store.db") as db:
        db.execute("CREATE TABLE entries(id TEXT PRIMARY KEY, vector_idx INTEGER, metadata TEXT, document TEXT)")
        db.executemany("INSERT INTO entries VALUES (?,?,?,?)", [("a", 1, '{"k": 1}', None), ("b", 0, "{}", "text")])
    rows = {r.id: r for r in vectorfile.import_rows(spark, path, str(tmp_path / "store.db")).collect()}
    assert rows["a"].vector == m[1].tolist() and rows["a"].metadata.toPython() == {"k": 1} and rows["b"].document == "text"


def test_approximate_search_recall(spark, tmp_path):
    rng = np.random.default_rng(7)
    m = rng.uniform(size=(1000, 32)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, vector array<float>")
    path = f"file://{tmp_path}/ann"
    ann.AnnIndex.write(rows, path, "euclidean", cells=16)
    index = ann.AnnIndex.open(spark, path)
    q = rng.uniform(size=(50, 32)).astype(np.float32)
    exact = np.argsort(((m[None] - q[:, None]) ** 2).sum(-1), axis=1)[:, :10]
    own = np.sqrt(((m[:, None] - index.centroids[None]) ** 2).sum(-1)).argmin(1)
    hits = [np.isin(own[exact[k]], index.cells(q[k])).mean() for k in range(50)]
    assert np.mean(hits) > 0.9
    got = index.search(q[0].tolist(), 10).collect()
    best = exact[0][np.isin(own[exact[0]], index.cells(q[0]))]
    assert [r.id for r in got][: len(best)] == best.tolist()
    assert got[0].score == pytest.approx(float(np.sqrt(((m[got[0].id] - q[0]) ** 2).sum())), rel=1e-6)
    plan = index.search(q[0].tolist(), 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_batch_nearest(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([m, m[:5]]))], "id int, vector array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m[:7])], "query_id int, query array<float>")
    whole = sorted(map(tuple, search.batch_nearest(rows, queries, 3).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 16)
    assert whole == sorted(map(tuple, search.batch_nearest(rows, queries, 3).select("query_id", "id", "rank").collect()))
    for k in range(5):
        assert {i for q, i, r in whole if q == k and r < 3} == {k, 60 + k} and len([1 for q, _, _ in whole if q == k]) == 3
    assert search.batch_nearest(rows, queries.limit(0), 3).count() == 0 and search.batch_nearest(rows.limit(0), queries, 3).count() == 0


def test_plans(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i) for i in range(9)], "id int, vector array<float>, label int")
    rows.write.parquet(str(tmp_path / "t"))
    near = search.nearest(spark.read.parquet(str(tmp_path / "t")).select("id", "vector"), [1.0, 0.0], 3)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "label" not in plan
    assert [r.id for r in near.collect()] == [8, 7, 6]


def test_index_and_merge(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "")], "id int, document string")
    path = f"file://{tmp_path}/ix"
    bm25.TextIndex.write(docs, path, parts=3)
    index = bm25.TextIndex.open(spark, path)
    for q, variant in (("red fox", "reference"), ("fox fox", "okapi"), ("none", "reference"), ("", "reference")):
        a = [(r.id, r.score) for r in index.search(q, 5, variant).collect()]
        b = [(r.id, r.score) for r in bm25.search(docs, q, 5, variant).select("id", "score").collect()]
        assert [x for x, _ in a] == [x for x, _ in b] and [x for _, x in a] == pytest.approx([x for _, x in b])
    assert tuple(bm25.corpus_stats(docs.limit(0)).first()) == (0, 0.0)
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    merged = merge.upsert(old, new)
    assert sorted((r.id, r.v) for r in merged.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(r.id for r in merge.delete(merged, new.select("id")).collect()) == [1]
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    b = spark.createDataFrame([("b", 1), ("d", 2), ("a", 3)], "id string, rank int")
    fused = fusion.rrf(a, b, 0.5).collect()
    assert [r.id for r in fused] == ["b", "a", "d", "c"] and fused[0].score == pytest.approx(0.5 / 62 + 0.5 / 61)
    assert fusion.rrf(a, b, 0.5, 0).count() == 0

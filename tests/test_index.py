"""An inverted index as it is written."""

from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq

from vectide.operators import bm25


def test_parts_of_an_index_are_sorted_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "TASK_WORDS", 500)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 60))) for i in range(200)] + [(500, None), (501, "")], "id int, document string")
    path = f"{tmp_path}/ix"
    bm25.TextIndex.write(docs, f"file://{path}", parts=2)
    index = bm25.TextIndex.open(spark, f"file://{path}")
    counts = sorted((t, i, n, len(d.split())) for i, d in docs.collect() if d for t, n in Counter(d.split()).items())
    assert sorted((r.term, r.id, r.tf, r.length) for r in index.postings.collect()) == counts
    files = sorted(Path(path).glob("postings/part=*/*.parquet"))
    assert len(files) == 12 and max(len(pq.read_table(f)) for f in files) < len(counts) / 6
    assert all((t := pq.read_table(f, columns=["term"], partitioning=None)["term"].to_pylist()) == sorted(t) for f in files)
    a, b = index.search("w5 w7 w7", 9), bm25.search(docs, "w5 w7 w7", 9)
    assert [r.id for r in a.collect()] == [r.id for r in b.collect()]

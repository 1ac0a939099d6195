"""The queries and the pipeline over given tables, each stage against brute force on its own input."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from vectide.llm import bpe
from vectide.llm.batches import drop_tables, tables_dir
from vectide.llm.mixing import shares
from vectide.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == list(QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_copies", "near_copies", "mixture", "encoding"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    tables = {"op4_chat_formatting": ("conversations", "conv_id")}
    table, key = tables.get(name, ("documents", "doc_id"))
    ids = {r[0] for r in duckdb.sql(f"SELECT {key} FROM '{SF}/{table}.parquet'").fetchall()}
    assert got and {r[key] for r in got} <= ids
    if name.split("_")[0] in ("op1", "op4", "op6", "op8", "op10"):
        assert {r[key] for r in got} == ids
    if name in SQL:
        found = duckdb.sql(SQL[name].replace("FROM documents", f"FROM '{SF}/documents.parquet'"))
        assert sorted(found.columns) == sorted(df.columns)
        assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[c] for c in found.columns)) for r in got)


def words(text, width=2):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name != "encoding":
            assert docs.columns == columns and all(after[i] == before[i] for i in after)
        if name == "toxicity":
            assert set(after) == set(before) - toxic
        elif name == "exact_copies":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i].text, i)
            assert set(after) == set(first.values())
        elif name == "near_copies":
            sets, root = {i: words(r.text) for i, r in before.items()}, {i: i for i in before}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a in before:
                for b in before:
                    if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
            want = {i for i in before if find(i) == i}
            assert want <= set(after) and len(set(after) - want) <= 0.05 * len(set(before) - want) + 1
        elif name == "mixture":
            size = {i: len(bpe.tiktoken_encoding(open(bpe.DEFAULT_VOCAB, "rb").read()).encode_ordinary(r.text)) for i, r in before.items()}
            total = {s: sum(size[i] for i, r in before.items() if r.source == s) for s in {r.source for r in before.values()}}
            want = shares(total, None, int(sum(total.values()) * 0.6))
            for s in total:  # small budgets are met as well as any choice of documents can
                sums = {0}
                for i, r in before.items():
                    if r.source == s:
                        sums |= {x + size[i] for x in sums if x + size[i] <= want[s]}
                assert sum(size[i] for i, r in after.items() if r.source == s) == max(sums)
        else:
            known = bpe.tiktoken_encoding(open(bpe.DEFAULT_VOCAB, "rb").read())
            assert set(after) == set(before) and all(list(after[i].token_ids) == known.encode_ordinary(before[i].text) and after[i].round_trip for i in after)
        before = after
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in run) == sorted(before)
    drop_tables(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def test_odd_stages(spark, tmp_path):
    rows = [(1, "same text here", "en", "a", 1), (1, "same text here", "en", "a", 1), (None, None, None, None, None), (2, "", "en", None, 0), (3, "long " * 30_000, "en", "b", 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for data, kept in ((rows, [None, 1, 2, 3]), ([], [])):
        docs = spark.createDataFrame(data, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(data)}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if name == "near_copies":
                assert sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x)) == kept

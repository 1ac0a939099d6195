import itertools

import numpy as np

from vectide.llm import bpe
from vectide.llm.mixing import fit_subset, mix_sources, shares

RAW = open(bpe.DEFAULT_VOCAB, "rb").read()


def test_shares():
    assert shares({"a": 100, "b": 100}, None, 100) == {"a": 50, "b": 50}
    assert shares({"a": 100, "b": 10, "c": 100}, None, 110) == {"a": 50, "b": 10, "c": 50}
    assert shares({"a": 100, "b": 100}, {"a": 3, "b": 1}, 80) == {"a": 60, "b": 20}
    assert shares({"a": 10}, None, 99) == {"a": 10} and shares({"a": 10}, {"x": 1}, 5) == {"a": 0} and shares({}, None, 5) == {} and shares({"a": 0}, None, 5) == {"a": 0}


def test_subsets_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(0, 30), 5, replace=False))
        counts = rng.integers(1, 4, 5)
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        take = fit_subset(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := int(np.dot(c, lengths))) <= budget)
        assert int((take * lengths).sum()) == best
        assert lengths[0] > 0 or take[0] == counts[0]


def test_large_budgets_are_met_exactly_and_evenly():
    rng = np.random.default_rng(4)
    lengths = np.arange(3, 4000)
    counts = rng.integers(1, 2000, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    take = fit_subset(lengths, counts, budget)
    assert int((take * lengths).sum()) == budget and (take <= counts).all()
    assert 0.3 < (take / counts)[2000:].mean() < 0.45  # long and short ones alike


def tokens(text):
    return len(bpe.tiktoken_encoding(RAW).encode_ordinary(text or ""))


def test_mix_of_documents(spark, make_text):
    rows = [(k, make_text(k, 5 + k % 40), ["hot", "b", "c"][0 if k % 2 else 1 + k % 4 // 2]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    total = sum(tokens(t) for _, t, _ in rows)
    got = mix_sources(docs, with_counts=True).collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.n_tokens == tokens(r.text) for r in got)
    by = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("hot", "b", "c")}
    want = shares({s: sum(tokens(t) for _, t, x in rows if x == s) for s in by}, None, int(total * 0.6))
    assert all(0 <= want[s] - by[s] <= 5 for s in by)
    again = mix_sources(docs.repartition(5), with_counts=True).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in got}
    assert {r.doc_id for r in mix_sources(docs, seed=8).collect()} != {r.doc_id for r in got}
    some = mix_sources(docs, weights={"b": 1.0, "none": 5.0}, budget_tokens=500, with_counts=True).collect()
    assert {r.source for r in some} == {"b"} and 0 <= 500 - sum(r.n_tokens for r in some) <= 5
    # The rule, by hand: of every length the least hashes.
    from pyspark.sql import functions as F

    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(7)).alias("h")).collect()}
    chosen = {r.doc_id for r in got}
    for s in by:
        own = [(tokens(t), hashed[k], k) for k, t, x in rows if x == s]
        lens = sorted({n for n, _, _ in own})
        take = fit_subset(np.array(lens), np.array([sum(n == m for m, _, _ in own) for n in lens]), want[s])
        expected = {k for n, c in zip(lens, take) for _, _, k in sorted(x for x in own if x[0] == n)[:c]}
        assert expected == {k for _, _, k in own} & chosen


def test_odd_rows(odd, empty):
    got = mix_sources(odd, budget_fraction=1.0).collect()
    assert len(got) == odd.count() and mix_sources(odd).columns == odd.columns
    part = mix_sources(odd, budget_tokens=8).collect()
    assert {r.doc_id for r in part if not r.text} == {3, 4, 5} and all(r.n_tokens == r.nid for r in part)
    assert mix_sources(empty).collect() == [] and mix_sources(empty, drop_text=True, with_counts=True).columns == ["doc_id", "source", "n_tokens"]


def test_a_group_of_equal_lengths_is_cut_by_ranges(spark):
    """Of one source and length: many rows, some of which repeat; as many are taken as the budget pays for, by least hash."""
    from pyspark.sql import functions as F

    docs = spark.range(30_000).select(F.when(F.col("id") < 20_000, F.col("id").cast("string")).otherwise(F.lit("again")).alias("doc_id"), F.lit("ten little words").alias("text"), F.lit("hot").alias("source"))
    each = tokens("ten little words")
    hashed = sorted(r.h for r in docs.select(F.xxhash64("doc_id", "text", F.lit(7)).alias("h")).collect())
    one = docs.where("doc_id = 'again'").select(F.xxhash64("doc_id", "text", F.lit(7))).first()[0]
    low = hashed.index(one)
    for n in (1, 300, low, low + 1, low + 4321, low + 10_000, 29_999):
        got = mix_sources(docs, budget_tokens=n * each)
        have = sorted(r.h for r in got.select(F.xxhash64("doc_id", "text", F.lit(7)).alias("h")).collect())
        assert have == hashed[:n]

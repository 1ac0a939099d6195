import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import components as cc
from vectide.llm import exact_dedup as exact
from vectide.llm import fuse, near, shingles
from vectide.llm import substring_dedup as dedup
from vectide.llm.fingerprints import PRINT, fingerprints, similar_pairs
from vectide.llm.minhash_dedup import NEAR, near_dedup
from vectide.llm.substring_dedup import AVERAGE, chunk_texts, cut_passages, gear, gear_hashes, repeated_spans, substring_dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filters(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = fuse.build(np.concatenate([keys, keys[:2]]))
    assert f.contains(keys).all() and f.contains(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.006
    assert n < 1000 or len(f.prints) * 8 / n < 11.5


def test_screening_by_shards(spark):
    old = spark.range(0, 3000).selectExpr("id * 7919 AS __d1", "id AS __d2")
    new = spark.range(2000, 6000).selectExpr("id * 7919 AS __d1", "id AS __d2")
    passed = {r.__d2 if hasattr(r, "__d2") else r[1] for r in exact.screen(new, exact.snapshot_filters(old, 4), 4).collect()}
    assert passed >= set(range(2000, 3000)) and len(passed) < 1100


def brute_exact(rows):
    seen, out = set(), []
    for doc_id, text, k in sorted(((r.doc_id, r.text, k) for k, r in enumerate(rows)), key=lambda x: (x[0] is None, x[0] or 0, x[2])):
        if text is None or text not in seen:
            out.append(k)
        seen.add(text)
    return out


def test_exact_dedup(spark, odd, empty, make_text):
    rng = random.Random(1)
    rows = [(rng.randrange(300), make_text(rng.randrange(60), 20), k) for k in range(400)] + [(k, "hot", 400 + k) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k int")
    for shard_keys in (exact.SHARD_KEYS, 7):
        got = exact.exact_dedup(df, shard_keys=shard_keys).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted((rows[k][0], rows[k][1]) for k in brute_exact(df.collect()))
    data = odd.collect()
    got = exact.exact_dedup(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:9]) for r in got.collect()) == sorted((data[k].doc_id is None, data[k].doc_id or 0, (data[k].text or "")[:9]) for k in brute_exact(data))
    assert exact.exact_dedup(empty).collect() == []


def test_ids_of_other_types_and_equal_ids(spark):
    rows = [("doc-10", "a", 1), ("doc-9", "a", 2), (None, "a", 3), ("doc-9", "b", 4), ("doc-9", "b", 5), (None, "c", 6), (None, "c", 7)]
    df = spark.createDataFrame(rows, "doc_id string, text string, k int")
    kept = [sorted((r.k for r in exact.exact_dedup(d).collect())) for d in (df, df.repartition(3), df.coalesce(1).orderBy("k", ascending=False))]
    assert kept[0] == kept[1] == kept[2] and 1 in kept[0] and len(kept[0]) == 3
    near_kept = [sorted((r.k for r in near_dedup(d).collect())) for d in (df, df.repartition(3))]
    assert near_kept[0] == near_kept[1] and 1 in near_kept[0] and len(near_kept[0]) == 3


def test_hot_texts_are_merged_before_they_meet(spark):
    df = spark.range(60_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a line that a third of all rows hold', concat('text ', id)) AS text")
    kept = exact.exact_dedup(df)
    assert kept.count() == 40_001 and kept.where("doc_id = 0").count() == 1


def test_equal_digests_are_not_enough(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "digests", lambda text: [F.lit(1).cast("bigint").alias("__d1"), F.lit(2).cast("bigint").alias("__d2")])
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in exact.exact_dedup(df).collect()) == [1, 2, 4]


def brute_sets(texts, width=2):
    out = []
    for t in texts:
        w = "".join(f" {c} " if "\u3040" <= c < "\ua000" else c for c in (t or "").lower()).split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def test_shingles():
    texts = ["", " ", "One", "one", "a b", "A  b\n", "a b c a b c", "x " * 500, "a\u00a0b\u3000c", "\u4e2d\u6587 a\u4e2d", "\u4e2d a", "\u00e9\U0001f600x \u2003y"]
    for width in (1, 2, 3):
        mine, brute = shingles.shingle_sets(texts, width), brute_sets(texts, width)
        assert list(map(len, mine)) == list(map(len, brute))
        for i in range(len(texts)):
            for j in range(len(texts)):
                union = len(brute[i] | brute[j])
                assert shingles.jaccard(mine[i], mine[j]) == (len(brute[i] & brute[j]) / union if union else 0.0)


def test_signatures_estimate_similarity(make_text):
    a = make_text(1, 300)
    b = a.replace("river", "sea").replace("fox", "cat")
    values, counts = shingles.shingles([a, b, ""], 2)
    sigs = shingles.signatures(values, counts, 2000, 3)
    true = shingles.jaccard(*shingles.shingle_sets([a, b], 2))
    assert abs((sigs[0] == sigs[1]).mean() - true) < 0.05 and (sigs[2] == 0xFFFFFFFF).all()


def test_bayesian_bounds():
    rng = np.random.default_rng(0)
    for t, n in ((0.6, 30), (0.7, 60), (0.5, 150)):
        m = near.least_matches(n, t, 0.01)
        s = rng.uniform(size=400_000)
        tail = lambda k: (s[rng.binomial(n, s) == k] >= t).mean()
        assert tail(m) >= 0.005 and tail(m - 2) < 0.012


@pytest.fixture(scope="module")
def copies(spark, make_text):
    """Documents, many of them edited or whole copies of others, and a group of 60 that are all alike."""
    rng = random.Random(9)
    texts = [make_text(k, rng.choice([30, 80, 200])) for k in range(80)]
    for k in range(120):
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randrange(len(w) // 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    base = make_text(999, 100).split()
    for k in range(60):
        w = list(base)
        w[k], w[99 - k // 2] = f"odd{k}", f"even{k}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 6 + ["", " ", None, "solo", "SOLO"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows


def brute_pairs(rows, t):
    sets = brute_sets([x for _, x in rows])
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}


def test_fingerprints_count_all_links(copies):
    df, rows = copies
    text = {i: (t or "").lower() for i, t in rows}
    sets = dict(zip(text, brute_sets([t for _, t in rows])))
    least = {}
    for i in sorted(text):
        least.setdefault(" ".join(text[i].split()) or i, i)
    name = {i: least[" ".join(t.split()) or i] for i, t in text.items()}
    want = {p for p in brute_pairs(rows, PRINT.threshold) if name[p[0]] == p[0] and name[p[1]] == p[1]}
    got = fingerprints(df).collect()
    assert len(got) == len(rows) and all(len(r.fingerprint) == (4 * PRINT.hashes if sets[r.doc_id] else 0) for r in got)
    assert all(r.class_id == name[r.doc_id] and r.copies == sum(n == name[r.doc_id] for n in name.values()) for r in got)
    pairs, member = similar_pairs(df)
    have = {(min(p.a_id, p.b_id), max(p.a_id, p.b_id)): p.jaccard for p in pairs.collect()}
    assert set(have) <= want and len(have) >= 0.97 * len(want)
    assert all(s == len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for (a, b), s in have.items())
    assert {(r.doc_id, r.class_id) for r in member.collect()} == {(i, n) for i, n in name.items() if sum(m == n for m in name.values()) > 1}
    for r in got:
        own = [s for p, s in have.items() if name[r.doc_id] in p]
        assert (r.links, r.most_like) == (len(own), max(own, default=None))
    blocks = {(r.doc_id, r.links, r.most_like) for r in fingerprints(df, block_docs=7).collect()}
    assert blocks == {(r.doc_id, r.links, r.most_like) for r in got}


def brute_kept(rows, t):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(rows, t):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i for i in root if find(i) == i}


def test_near_dedup(copies):
    df, rows = copies
    want, got = brute_kept(rows, NEAR.threshold), {r.doc_id for r in near_dedup(df).collect()}
    gone, found = {i for i, _ in rows} - want, {i for i, _ in rows} - got
    assert found <= gone and len(found) >= 0.97 * len(gone)


@pytest.mark.parametrize("block", [1, 7, 40])
def test_large_components_are_checked_by_blocks(copies, block):
    df, rows = copies
    assert {r.doc_id for r in near_dedup(df, block_docs=block).collect()} == {r.doc_id for r in near_dedup(df).collect()}


def test_a_chain_of_like_documents_and_a_crowd_of_equal_ones(spark, make_text):
    """Each of the chain is like the next and not like those far off; the crowd is one row of three."""
    words = make_text(77, 2400).split()
    chain = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(580)]
    crowd = [(1000 + k, "the very same words for everyone") for k in range(700)]
    other = [(5000 + k, make_text(9000 + k, 50)) for k in range(100)]
    df = spark.createDataFrame([*chain, *crowd, *other], "doc_id bigint, text string").repartition(5)
    assert {r.doc_id for r in near_dedup(df, block_docs=60).collect()} == {0, 1000} | {i for i, _ in other}
    got = {r.doc_id: r for r in fingerprints(df, block_docs=60).collect()}
    assert all(r.class_id == 1000 and r.copies == 700 and r.links == 0 for i, r in got.items() if 1000 <= i < 5000)
    links = brute_pairs(chain, PRINT.threshold)
    assert sum(got[i].links for i, _ in chain) >= 0.97 * 2 * len(links)


def test_scripts_without_spaces(spark):
    rng = random.Random(6)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    far = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    df = spark.createDataFrame([(1, text), (2, text[:1500] + "\u4e2d" + text[1500:]), (3, far)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_dedup(df).collect()) == [1, 3]
    assert sorted((r.doc_id, r.links) for r in fingerprints(df).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_tasks_across_classes(spark):
    """Every two members of different classes meet in one task, whatever the blocks."""
    rng = random.Random(3)
    data = [(g, 1000 * g + k, 0 if rng.random() < share else rng.randrange(1, 4)) for g, share in ((1, 0.9), (2, 0.3), (3, 0.0)) for k in range(40)]
    members = spark.createDataFrame(data, "g bigint, nid bigint, class bigint")
    met = set()
    tasks = defaultdict(list)
    for r in near._across(members, 6).collect():
        tasks[r.g, r.p, r.q].append(r)
    for rows in tasks.values():
        assert len(rows) <= 40
        met |= {frozenset((x.nid, y.nid)) for x in rows for y in rows if x["class"] != y["class"] and (x.side < 0 or x.side != y.side)}
    assert met == {frozenset((a[1], b[1])) for a in data for b in data if a[0] == b[0] and a[2] != b[2]}


def test_near_odd_rows(odd, empty):
    got = near_dedup(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text is None) for r in got.collect()) == [(0, False), (1, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, False), (9, False), (10, False)]
    prints = fingerprints(odd).collect()
    assert len(prints) == odd.count() and sorted((r.class_id, r.copies, r.links) for r in prints if r.doc_id in (1, 2)) == [(1, 3, 0)] * 3
    assert near_dedup(empty).collect() == [] and fingerprints(empty).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_union_find(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    assert dict(zip(*(x.tolist() for x in cc.union_find(a, b)))) == root


def test_components_by_rounds(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (200, 200)]
    df = spark.createDataFrame(chain, "a bigint, b bigint")
    assert sorted(map(tuple, cc.components(df, 0).collect())) == sorted(map(tuple, cc.components(df).collect()))
    assert cc.components(df.limit(0)).collect() == [] == cc.components(df.limit(0), -1).collect()


def brute_chunks(data: bytes):
    """The hash byte by byte; a cut where it is small, moved out of characters, and every 1024 bytes without one."""
    g, cuts = gear().tolist(), {0, len(data)}
    for i in range(len(data)):
        h = sum(g[data[j]] << (i - j) for j in range(max(0, i - 31), i + 1)) % (1 << 32)
        if h < (1 << 32) // AVERAGE:
            c = i + 1
            while c < len(data) and data[c] & 0xC0 == 0x80:
                c += 1
            cuts.add(c)
    cuts = sorted(cuts)
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def test_chunks(make_text):
    texts = ["", make_text(1, 80), "é中" * 40, "a", make_text(2, 30) + "é"]
    where, start, words, chunks = chunk_texts([t.encode() for t in texts])
    by = defaultdict(list)
    for w, s, c in zip(where.tolist(), start.tolist(), chunks):
        assert sum(map(len, by[w])) == s
        by[w].append(c)
    for k, t in enumerate(texts):
        assert by[k] == (brute_chunks(t.encode()) if t else [])
        alone = t.count("\u4e2d")  # a character of a script without spaces is half a word
        assert sum(w for x, w in zip(where.tolist(), words.tolist()) if x == k) == (2 * len(t.replace("\u4e2d", " ").split()) + alone)
    assert max(map(len, chunk_texts([b"a" * 10_000])[3])) <= 1024 and chunk_texts([])[3] == []
    long = ("é" * 5000).encode()
    assert all(c.decode() for c in chunk_texts([long])[3]) and b"".join(chunk_texts([long])[3]) == long


def test_chunks_resist_insertions(make_text):
    text = make_text(3, 400)
    a, b = (set(chunk_texts([t.encode()])[3]) for t in (text, "put in before. " + text[:700] + "XX" + text[700:]))
    assert len(a & b) >= len(a) - 6
    assert np.array_equal(gear_hashes(np.frombuffer(text.encode(), np.uint8))[40:], gear_hashes(np.frombuffer(("??" + text).encode(), np.uint8))[42:])


def test_repeated_passages(spark, make_text):
    rng = random.Random(2)
    rows = [(k, make_text(1000 + k, 120)) for k in range(60)]
    planted = {}
    for p in range(10):
        passage, (a, b) = make_text(5000 + p, 60), (3 * p, 3 * p + 1)
        for k in (a, b):
            w = rows[k][1].split(" ")
            c = rng.randrange(len(w))
            rows[k] = (k, " ".join([*w[:c], passage, *w[c:]]))
            planted[k] = passage
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = repeated_spans(df).collect()
    assert {r.doc_id for r in got} == set(planted)
    text = dict(rows)
    for r in got:
        piece = text[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert len(set(piece.split()) & set(planted[r.doc_id].split())) >= 0.9 * len(piece.split()) and r.n_words >= 20
        assert r.doc_id - r.doc_id % 3 in r.first_ids and (r.is_later or r.doc_id % 3 == 0)
    clean = {r.doc_id: r.text for r in substring_dedup(df).collect()}
    for k, t in rows:
        assert len(clean[k]) < len(t) - 150 if k % 3 == 1 and k in planted else len(t) - len(clean[k]) < 100
    # What is reported is what brute force finds: chunks that two documents have.
    docs_of = defaultdict(set)
    for k, t in rows:
        for c in brute_chunks(t.encode()):
            docs_of[c].add(k)
    shared = {k: sum(len(c) for c in brute_chunks(t.encode()) if len(docs_of[c]) > 1) for k, t in rows}
    every = repeated_spans(df, least_words=0).collect()
    assert {k: n for k, n in shared.items() if n} == {k: sum(r.end_byte - r.start_byte for r in every if r.doc_id == k) for k in {r.doc_id for r in every}}


def test_hot_passages_are_spread(spark, make_text, monkeypatch):
    """Half of the rows hold one passage; whether it counts as hot changes nothing."""
    passage = make_text(31, 60)
    rows = [(k, make_text(2000 + k, 40) + (" " + passage + " " + make_text(3000 + k, 10) if k % 2 else "")) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    cold = sorted(map(tuple, cut_passages(df).collect()))
    plain = dedup._repeated
    with monkeypatch.context() as m:
        m.setattr(dedup, "_repeated", lambda x: plain(x, hot_least=5, hot_share=2))
        assert sorted(map(tuple, cut_passages(df).collect())) == cold
        spans = sorted((r.doc_id, r.start_byte, r.end_byte, r.n_words, r.is_later, tuple(r.first_ids)) for r in repeated_spans(df).collect())
    assert spans == sorted((r.doc_id, r.start_byte, r.end_byte, r.n_words, r.is_later, tuple(r.first_ids)) for r in repeated_spans(df).collect())
    assert {r[0] for r in cold} == {k for k in range(240) if k % 2} and all(s[5][0] == 1 for s in spans)  # a chunk may reach a letter or two beyond
    full = {r.doc_id: r.text for r in substring_dedup(df).collect()}
    assert all(full[i] == text for i, _, text in cold) and all(full[k] == t for k, t in rows if k % 2 == 0)
    for i, spans, text in cold:
        data = dict(rows)[i].encode()
        assert i == 1 or sum(s.n_words for s in spans if s.is_later) > 40
        for s in reversed([s for s in spans if s.is_later]):
            data = data[: s.start_byte] + data[s.end_byte :]
        assert data.decode() == text


def test_passages_without_spaces(spark):
    rng = random.Random(8)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared = text(600)
    df = spark.createDataFrame([("b", text(300) + shared + text(200)), ("a", text(100) + shared), ("c", text(900)), (None, shared), ("b", shared)], "doc_id string, text string")
    got = {(r.doc_id, len(r.text)): r.passages for r in cut_passages(df).collect()}
    assert len(got) == 4 and sum(any(p.is_later for p in ps) for ps in got.values()) == 3 and ("a", 700) in got
    assert all(n < 600 for i, n in got if i != "a")


def test_cutting_texts():
    import pyarrow as pa

    texts = pa.array(["skip", "h\u00e9llo w\u00f6rld", None, "", "abcdef", "xyz"]).slice(1)
    cuts = pa.array([[0], [0, 7, 5], None, None, [0, 1, 5, 1, 3, 4, 4, 6, 5], []], pa.list_(pa.int64())).slice(1)
    assert dedup.without(texts, cuts).to_pylist() == ["w\u00f6rld", None, "", "bcd", "xyz"]


def test_substring_odd_rows(odd, empty):
    got = repeated_spans(odd, least_words=1).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.first_ids == [1] for r in got)
    clean = substring_dedup(odd, least_words=1)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    texts = {r.nid: r.text for r in clean.collect()}
    assert texts[2] == "" and sorted([texts[0], texts[1]]) == ["", "plain text, it's here"] and texts[4] is None and texts[5] == ""
    assert sorted((r.doc_id, r.text) for r in cut_passages(odd, least_words=1).collect()) == [(1, ""), (1, "plain text, it's here"), (2, "")]
    assert repeated_spans(empty).collect() == [] and substring_dedup(empty).collect() == [] and cut_passages(empty).collect() == []

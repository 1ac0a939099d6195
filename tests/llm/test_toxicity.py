import itertools
import random

import numpy as np
import pytest

from vectide.llm import toxicity as tox

INSULTS = ["idiot", "stupid", "loser", "pathetic", "worthless"]


def brute_kernel(a: str, b: str) -> float:
    """Shared triples within the span, each weighted by its length in both words, over the words' own lengths."""

    def features(word):
        s = "^" + word + "$"
        own, norm = {}, 0.0
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < tox.SPAN:
                w = tox.DECAY ** (k - i + 1)
                own[s[i], s[j], s[k]] = own.get((s[i], s[j], s[k]), 0.0) + w
                norm += w * w
        return own, norm**0.5

    (f, n), (g, m) = features(a), features(b)
    return sum(x * g.get(u, 0.0) for u, x in f.items()) / (n * m)


def test_kernel_is_the_sum_over_shared_subsequences():
    words = ["idiot", "idixot", "stone", "banana", "ab", "idiots"]
    phi = tox.kernel_features(words)
    assert phi @ phi.T == pytest.approx(np.array([[brute_kernel(a, b) for b in words] for a in words]), abs=1e-5)
    assert tox._kernel(words, phi)[0] == pytest.approx(phi @ phi.T, abs=1e-5)
    assert brute_kernel("idiot", "idxiot") > 3 * brute_kernel("idiot", "stone")


def test_folded_weights_score_as_the_landmarks_do():
    rng = np.random.default_rng(1)
    marks = tox.kernel_features(["idiot", "stone", "loser"])
    beta = rng.normal(size=3)
    machine = tox.Machine((marks.T @ beta).astype(np.float32), -0.3, 0.0)
    words = ["idiot", "idiotic", "stones", "x", "", "..."]
    got = machine.words(words)
    assert got[:3] == pytest.approx(tox._kernel(words[:3], marks)[0] @ beta - 0.3, abs=1e-4)
    long = "abcdefgh" * 10 + "idiot" + "hgfedcba" * 10
    assert machine.words([long])[0] >= max(machine.words(["abcdefgh"])[0], -0.3) and np.isfinite(machine.words(["z" * 5000])[0])


def test_spelt_out_words():
    assert "idiot" in tox.split_words("You I D I O T there") and tox.split_words(" \n") == []
    assert tox.split_words("a b") == ["a", "b"] and "idiot" in tox.split_words("i  d\ni o   t")


def test_long_words_are_learnt_by_all_their_windows():
    long = "q" * 20 + "idiot" + "z" * 20
    phi = tox.kernel_features([long, "idiot"])
    kernel, word = tox._kernel([long, "idiot"], phi)
    assert word.tolist() == [0] * (len(phi) - 1) + [1] and len(phi) > 3
    assert kernel == pytest.approx(phi @ phi.T, rel=1e-4)
    bags = [[f"stone{k}", f"river{k}"] for k in range(60)] + [[f"stone{k}", long] for k in range(60, 90)]
    machine = tox.train(bags, [0] * 60 + [1] * 30)
    assert machine.words([long])[0] > 0 > machine.words(["stone99"])[0]


def test_wrong_labels_clear_no_insult():
    """One in a hundred labels is wrong, so that clean documents hold insults too."""
    rng = random.Random(12)
    syllables = ["ba", "ren", "to", "mi", "kul", "sha", "dor", "ne", "ta", "vi", "gu", "len"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))
    bags = [[word() for _ in range(20)] + ([rng.choice(INSULTS)] if k % 4 == 0 else []) for k in range(1600)]
    said = [int(k % 4 == 0) ^ int(rng.random() < 0.01) for k in range(1600)]
    machine = tox.train(bags, said)
    assert all(machine.words([w])[0] >= machine.cut for w in INSULTS)
    fresh = [[word() for _ in range(20)] for _ in range(300)]
    assert sum(machine.words(b).max() >= machine.cut for b in fresh) <= 6


@pytest.fixture(scope="module")
def corpus(make_text):
    """Documents of made-up words; every eighth has two insults in it, and half of all are labelled."""
    rng = random.Random(4)
    syllables = ["ba", "ren", "to", "mi", "kul", "sha", "dor", "ne", "ta", "vi", "gu", "len", "pro", "ster", "and", "ing", "ous", "ly"]
    rows, toxic = [], {}
    for k in range(1200):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
        toxic[k] = int(k % 8 == 0)
        if toxic[k]:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(INSULTS)
        rows.append((k, " ".join(words[:20]) + ".\n" + " ".join(words[20:])))
    return rows, toxic


def test_held_out_documents(spark, corpus):
    rows, toxic = corpus
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, t) for k, t in toxic.items() if k % 16 < 8], "doc_id bigint, toxic int")
    found = {r.doc_id: r.toxicity for r in tox.toxic_documents(docs, labels).collect()}
    held = [k for k in toxic if k % 16 >= 8]
    assert sum(k in found for k in held if toxic[k]) >= 0.97 * sum(toxic[k] for k in held)
    assert sum(k in found for k in held if not toxic[k]) <= 0.01 * len(held)
    kept = {r.doc_id for r in tox.drop_toxic(docs, labels).collect()}
    assert kept == set(toxic) - set(found)
    machine = tox.fit(docs, labels)
    again = tox.fit(docs.repartition(5), labels.repartition(2))
    assert np.array_equal(machine.weights, again.weights) and machine.cut == again.cut
    # Scoring in Spark is scoring word by word.
    scored = {r.doc_id: r.toxicity for r in tox.score(docs, machine).collect()}
    assert all(scored[k] == pytest.approx(max(float(machine.words([w])[0]) for w in tox.split_words(t)), abs=1e-4) for k, t in rows[:40])
    clash = tox.score(docs.selectExpr("text AS Text", "doc_id AS `a.b`", "'x' AS toxicity", "1 AS __text"), machine)
    assert clash.columns == ["Text", "a.b", "__text", "toxicity"] and {r["a.b"]: r.toxicity for r in clash.collect()} == scored
    disguised = ["i d i o t", "s.t.u.p.i.d", "l-o-s-e-r", "idixot", "stuqpid", "pathzetic", "worthkless"]
    assert np.mean([machine.words(tox.split_words(d)).max() >= machine.cut for d in disguised]) >= 0.7


def test_odd_rows(spark, odd, empty, corpus):
    rows, toxic = corpus
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([*((k, t, "x") for k, t in toxic.items()), (None, 1, "x"), (1, None, "x"), (8, 0, "x"), (8, 1, "x")], "doc_id bigint, toxic int, text string")
    machine = tox.fit(docs, labels)
    scored = tox.score(odd, machine).collect()
    assert len(scored) == odd.count() and sorted(k for k, r in enumerate(sorted(scored, key=lambda r: r.nid)) if r.toxicity is None) == [4, 5, 6, 7]
    kept = tox.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and {4, 5, 6, 7} <= {r.nid for r in kept.collect()}  # without words: never toxic
    assert tox.toxic_documents(docs, labels.limit(0)).collect() == [] == tox.toxic_documents(empty, labels).collect()
    assert tox.drop_toxic(empty, labels).collect() == [] and tox.drop_toxic(docs, labels.limit(0)).count() == len(rows)
    assert tox.toxic_documents(docs, labels.where("toxic = 0")).collect() == []
    assert tox.train([["a"], []], [1, 0]).words(["a"])[0] < np.inf

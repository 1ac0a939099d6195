"""Texts with runs of white space that tiktoken's own pattern fails on."""

import numpy as np

from vectide.llm import bpe
from vectide.llm.mixing import mix_sources
from vectide.llm.token_counts import count_texts
from vectide.llm.token_store import token_store, unpack

RAW = open(bpe.DEFAULT_VOCAB, "rb").read()


def test_long_runs_of_white_space(spark, make_text, monkeypatch):
    known, rng = bpe.tiktoken_encoding(RAW), np.random.default_rng(8)
    with monkeypatch.context() as m:  # short runs, for which tiktoken itself can be asked
        m.setattr(bpe, "LONG_WHITE", 3)
        bpe._long_white.cache_clear()
        for _ in range(400):
            text = "".join(rng.choice(list("ab7!'s \n\t 　\x1c "), int(rng.integers(0, 40)), p=[0.06] * 6 + [0.16, 0.16, 0.06, 0.06, 0.04, 0.06, 0.1]))
            assert bpe.tiktoken_ids(text, RAW) == known.encode_ordinary(text)
    bpe._long_white.cache_clear()
    blank = " " * 2_000_000
    texts = [blank, "word" + blank + "word", "\n" * 1_500_000 + "x", make_text(1, 20), None, ""]
    want = [int(n) for n in count_texts([t or "" for t in texts], RAW)]
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    mixed = mix_sources(docs, budget_fraction=1.0, with_counts=True).collect()
    assert {r.doc_id: r.n_tokens for r in mixed} == dict(enumerate(want))
    stored = {r.doc_id: r for r in token_store(docs, dictionary=b"").collect()}
    assert [stored[k].n_tokens for k in range(len(texts))] == want
    for k, t in enumerate(texts):
        assert known.decode(unpack(bytes(stored[k].payload), list(stored[k].frame_offsets), b"").tolist()) == (t or "")

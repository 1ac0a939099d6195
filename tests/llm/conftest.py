import random

import pytest

WORDS = "the of and to river stone quick brown fox jumps over lazy dog winter garden music paper light green yellow house engine number seven early often never always market ocean silver copper".split()


@pytest.fixture(scope="session")
def make_text():
    def make(seed: int, words: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(words))

    return make


#: Rows that every operator has to bear: nulls, empty and blank texts, ties, repeated rows, long texts.
ODD = [(1, "plain text, it's here", "a"), (1, "plain text, it's here", "a"), (2, "plain text, it's here", "b"), (None, "no id", None), (3, None, "a"), (4, "", "a"), (5, "", "b"), (6, " \n\t ", "a"), (7, "word", "b"), (8, "  two  words\n", "a"), (9, "é中\U0001f600 ' 'll 1234", "b")]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use inside, and two that differ in case only."""
    rows = [(*r, k, "x", k) for k, r in enumerate([*ODD, (10, "long word7 " * 60_000, "a")])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int, __text string, nid int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string")

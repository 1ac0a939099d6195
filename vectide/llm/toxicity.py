"""Operator 5, toxicity: a support vector machine over Nyström features of a gap-weighted subsequence string kernel.

The kernel compares two words by the letter triples that they share, in order
but not necessarily side by side, each weighted by DECAY for every letter that
it spans, so that a gap or an inserted letter costs little.  A sentence is
scored by its most toxic word, a document by its most toxic sentence.  Labels
are given for documents; the words to blame in them are found by alternating
between training and picking (multiple-instance learning).

Since the decision function is linear in the landmarks' kernel values, and each
of these is a sum over triples, the trained machine folds into one weight per
triple: scoring needs no landmark and no table of kernel values.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import claim, map_text, narrowed, positional
from .shingles import band_keys, shingles, signatures

DECAY, SPAN, SYMBOLS = 0.7, 5, 32
#: Weight of disguised insults against plain ones, and the machine's ridge.
ODD, RIDGE = 0.8, 0.3
#: Disguised forms made of each of the commonest insults, and how many of all are landmarks.
ODD_FORMS, ODD_MARKS = 24, 128
#: Longer words are learnt and scored by windows of so many symbols, half overlapping.
WINDOW = 16
CACHE_WORDS = 250_000
_SPACED = re.compile(r"(?<!\S)\S(?:\s{1,3}\S(?!\S)){2,}")


class _Alphabet(dict):
    """Letters a to z as symbols 0 to 25, digits 26, other letters 27 to 30; the rest is dropped. 31 marks both ends."""

    def __missing__(self, cp: int):
        char = unicodedata.normalize("NFKC", chr(cp))[:1].lower()
        if "a" <= char <= "z":
            out = chr(ord(char) - 97)
        elif char.isdigit():
            out = chr(26)
        elif char.isalpha():
            out = chr(27 + cp % 4)
        else:
            out = None
        self[cp] = out
        return out


_ALPHABET, _END = _Alphabet(), chr(31)


@lru_cache(maxsize=None)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, k, weight) of all triples of n places that span SPAN places at most, scaled to unit length."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = np.array(found, np.int64).reshape(-1, 3).T
    weight = (DECAY ** (k - i + 1)).astype(np.float32)
    return i, j, k, weight / np.linalg.norm(weight) if len(weight) else weight


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all symbols, first symbol and length of each word)."""
    coded = [f"{_END}{c}{_END}" if (c := w.translate(_ALPHABET)) else "" for w in words]
    lens = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.frombuffer("".join(coded).encode("latin-1"), np.uint8).astype(np.int64), np.cumsum(lens) - lens, lens


def _windows(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, first symbol, length) of the windows of each word."""
    half = WINDOW // 2
    number = np.where(lens <= WINDOW, 1, -(-(lens - WINDOW) // half) + 1)
    word = np.repeat(np.arange(len(lens)), number)
    part = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    at = np.minimum(part * half, np.maximum(lens[word] - WINDOW, 0))
    return word, starts[word] + at, np.minimum(lens[word], WINDOW)


def _codes(symbols: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The triples of words of n symbols, as numbers."""
    i, j, k, _ = triples(n)
    x = symbols[starts[:, None] + np.arange(n)]
    return x[:, i] * (SYMBOLS * SYMBOLS) + x[:, j] * SYMBOLS + x[:, k]


def _of_size(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """(symbols, word of each window, (n, windows of n symbols, where they begin) for each n that has any)."""
    symbols, starts, lens = _symbols(words)
    word, at, size = _windows(starts, lens)
    found = ((n, np.flatnonzero(size == n)) for n in range(3, WINDOW + 1))
    return symbols, word, [(n, which, at[which]) for n, which in found if len(which)]


def kernel_features(words: list[str]) -> np.ndarray:
    """Explicit features of the words' windows, short words being one: their kernel is the rows' inner product."""
    symbols, word, sizes = _of_size(words)
    out = np.zeros((SYMBOLS**3, len(word)), np.float32)
    for n, which, at in sizes:
        codes = _codes(symbols, at, n)
        np.add.at(out, (codes.ravel(), np.repeat(which, codes.shape[1])), np.tile(triples(n)[3], len(which)))
    return out.T


@dataclass
class Machine:
    """weights: one per triple of symbols; a word's score is their weighted sum, plus bias; at least cut is toxic."""

    weights: np.ndarray
    bias: float
    cut: float

    def words(self, words: list[str]) -> np.ndarray:
        symbols, starts, lens = _symbols(words)
        word, at, size = _windows(starts, lens)
        score = np.full(len(at), self.bias, np.float32)
        for n in range(3, WINDOW + 1):
            which = np.flatnonzero(size == n)
            for lo in range(0, len(which), 4096):
                some = which[lo : lo + 4096]
                score[some] += self.weights[_codes(symbols, at[some], n)] @ triples(n)[3]
        best = np.full(len(words), -np.inf, np.float32)
        np.maximum.at(best, word, score)
        return best


def split_words(text: str) -> list[str]:
    """Words as they stand, and what is spelt out letter by letter as one word more."""
    low = text.lower()
    words = low.split()
    if spelt := _SPACED.findall(low):
        words += ["".join(s.split()) for s in spelt]
    return words


def _unlike(sets: list[list[str]]) -> list[int]:
    """The documents that share no band of min-wise hashes of their words with an earlier one."""
    seen: set[int] = set()
    out = []
    for lo in range(0, len(sets), 256):
        values, counts = shingles([" ".join(b) for b in sets[lo : lo + 256]], 1)
        for i, own in enumerate(band_keys(signatures(values, counts, 24, 1), 8).tolist(), lo):
            if seen.isdisjoint(own):
                out.append(i)
            seen.update(own)
    return out


def _disguised(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with a letter put in somewhere inside."""
    out = []
    for w in words:
        if len(w) > 3:
            at = int(rng.integers(1, len(w) - 1))
            out.append(w[:at] + chr(97 + int(rng.integers(26))) + w[at:])
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 15) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last column of z is the constant."""
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        active = np.flatnonzero(y * (z @ w.astype(np.float32)) < 1)
        left, right = np.diag(penalty), np.zeros(len(w))
        for lo in range(0, len(active), 2048):  # so that only a slice of z is held as doubles
            at = active[lo : lo + 2048]
            za = z[at].astype(np.float64)
            left += (za * weight[at, None]).T @ za
            right += za.T @ (weight[at] * y[at])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _nystroem(landmarks: np.ndarray) -> np.ndarray:
    """Root of the landmarks' inverse kernel matrix, small eigenvalues left out."""
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    return (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T


def _kernel(words: list[str], landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kernel of each window of the words with each landmark, the window's word)."""
    symbols, word, sizes = _of_size(words)
    table = landmarks.T  # rows by triple, as kernel_features lays them out
    out = np.zeros((len(word), len(landmarks)), np.float32)
    for n, which, at in sizes:
        weight = triples(n)[3]
        for lo in range(0, len(which), 64):
            some = which[lo : lo + 64]
            out[some] = np.einsum("btl,t->bl", table[_codes(symbols, at[lo : lo + 64], n)], weight, optimize=True)
    return out, word


def train(bags: list[list[str]], toxic: list[int], landmarks: int = 384, negatives: int = 12_000, blamed_most: int = 500, hard_most: int = 2000, sure: int = 6, ratio: float = 20.0, rounds: int = 4, seed: int = 5) -> Machine:
    """A machine from the words of documents labelled 1 (some word is toxic) or 0 (none is).

    Of documents that are near copies one is used.  A quarter is held out to
    place the cut, in the gap that separates the classes with the fewest errors.
    A word can be to blame if toxic documents have it `ratio` times as often as
    clean ones, so that a wrong label or a quotation clears no insult.  Those that
    `sure` toxic documents have are to blame; in documents without one, those that
    the machine trained so far finds.  Every window of a long word is an example.
    Without documents of both classes nothing is ever toxic.

    The machine learns from at most `negatives` clean words, a third of them the
    commonest, `hard_most` more that score high, and, where no word is sure, `blamed_most` words to blame.
    """
    rng = np.random.default_rng(seed)
    never = Machine(np.zeros(SYMBOLS**3, np.float32), -1.0, np.inf)
    sets = [sorted(set(b)) for b in bags]
    order = [i for i in _unlike(sets) if sets[i]]
    order = [order[i] for i in rng.permutation(len(order))]
    held, used = order[: len(order) // 4], order[len(order) // 4 :]
    bad = [sets[i] for i in used if toxic[i]]
    good = [sets[i] for i in used if not toxic[i]]
    if not bad or not good:
        return never
    clean = Counter(w for b in good for w in b)
    blamed = Counter(w for b in bad for w in b)
    blamed = Counter({w: n for w, n in blamed.items() if n * len(good) >= ratio * clean[w] * len(bad)})
    clean = Counter({w: n for w, n in clean.items() if w not in blamed})
    if not blamed or not clean:
        return never
    common = [w for w, _ in clean.most_common(negatives // 3)]
    rest = sorted(set(clean) - set(common))
    clean_words = common + [rest[i] for i in rng.permutation(len(rest))[: negatives - len(common)]]
    # Words that several toxic documents have and hardly any other one does are to blame in any case.
    given = {w: float(n) for w, n in blamed.items() if n >= sure}
    open_bags = [b for b in bad if not any(w in given for w in b)]
    positives = given or {w: float(n) for w, n in blamed.most_common(blamed_most)}
    machine, every = never, sorted(clean)
    hard: list[str] = []
    for step in range(rounds):
        words = sorted(positives)
        half = landmarks // 2
        top = sorted(words, key=lambda w: (-positives[w], w))[:half]
        odd = [d for k in range(ODD_FORMS) for d in _disguised(top if k < 3 else top[:32], rng)] if step else []
        chosen = top + odd[: ODD_MARKS] + hard[: half // 2] + [clean_words[i] for i in rng.permutation(len(clean_words))[: landmarks - len(top) - len(hard[: half // 2])]]
        feats = kernel_features(list(dict.fromkeys(chosen)))
        if not (some := feats.any(axis=1)).all():
            feats = np.ascontiguousarray(feats.T[:, some]).T
        root = _nystroem(feats)
        sample = words + odd + clean_words + hard
        kernel, word = _kernel(sample, feats)
        z = np.ones((len(word), root.shape[1] + 1), np.float32)
        np.matmul(kernel, root.astype(np.float32), out=z[:, :-1])
        bad_ones = len(words) + len(odd)
        y = np.concatenate([np.ones(bad_ones), -np.ones(len(sample) - bad_ones)])
        share = np.sqrt(np.array([positives[w] for w in words]))
        share = np.concatenate([share / share.sum(), np.full(len(odd), ODD / max(1, len(odd)))])
        weight = np.concatenate([share / share.sum(), np.full(len(sample) - bad_ones, 1 / (len(sample) - bad_ones))]) * len(sample)
        weight = np.where(y > 0, weight / np.bincount(word, minlength=len(sample)), weight)  # a word to blame shares its weight among its windows
        w = _svm(z, y[word], weight[word], ridge=RIDGE)
        machine = Machine((feats.T @ (root @ w[:-1])).astype(np.float32), float(w[-1]), 0.0)
        # Blame what this finds in documents without a given word; keep the clean words that score high.
        asked = list({w for b in open_bags for w in b if w in blamed})
        scored = dict(zip(asked, machine.words(asked).tolist()))
        found: Counter = Counter()
        for b in open_bags:
            found.update(w for w in b if scored.get(w, -1.0) > 0.5)
        positives = (given | {w: float(n) for w, n in found.items()}) or positives
        got = np.concatenate([machine.words(every[lo : lo + 50_000]) for lo in range(0, len(every), 50_000)])
        hard = [every[i] for i in np.argsort(-got, kind="stable")[:hard_most]]
    best = [(float(machine.words(sets[i]).max()) if sets[i] else -np.inf, int(toxic[i])) for i in held]
    machine.cut = _cut(best)
    return machine


def _cut(scored: list[tuple[float, int]]) -> float:
    """A third into the widest gap among those that make fewest errors, an innocent one counting five times."""
    scored = sorted(x for x in scored if np.isfinite(x[0]))
    if not scored:
        return 0.5
    s = np.array([x[0] for x in scored])
    t = np.array([x[1] for x in scored])
    missed = np.concatenate([[0], np.cumsum(t)])
    wrong = np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    cost = missed + 5 * wrong
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    gaps = np.diff(edges)
    at = np.flatnonzero(cost == cost.min())
    at = at[np.argmax(gaps[at])]
    return float((2 * edges[at] + edges[at + 1]) / 3)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", toxic_docs: int = 2000, clean_docs: int = 6000, seed: int = 5, **how) -> Machine:
    """A machine trained on at most toxic_docs and clean_docs labelled documents, whole, however long; how: bounds on words, see train().

    The sample holds the least seeded hashes of ids.  A document with several
    labels is toxic if one says so; rows with null ids, labels or texts are left out; of rows
    with one id each counts.  Only documents' distinct words are shuffled.
    """
    given, place = positional(labels)
    own = given.select(F.col(place(id_col)).alias("__id"), F.col(place(label_col)).cast("int").alias("__toxic")).dropna().groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    key = F.xxhash64("__id", F.lit(seed))
    chosen = own.where("__toxic = 1").orderBy(key, "__id").limit(toxic_docs).union(own.where("__toxic = 0").orderBy(key, "__id").limit(clean_docs))
    rows = narrowed(docs, [id_col], text_col)[0].toDF("__id", "__text").where(F.length("__text") > 0)
    sample = rows.join(F.broadcast(chosen), "__id").select(F.xxhash64("__id", "__text").alias("h"), F.col("__toxic").alias("toxic"), "__text")  # of bounded size on either side

    def bag(batch: pa.RecordBatch, lo: int, texts: list[str]) -> pa.RecordBatch:
        claim("training", triples.cache_clear)  # every worker, not that of the training alone, lets go of what others cached
        words = pa.array(["\n".join(sorted(set(split_words(t)))) for t in texts], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), words], names=["h", "toxic", "words"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        claim("training", triples.cache_clear)
        frame = frame.sort_values(["h", "words"], kind="stable")
        one: dict[str, str] = {}
        bags = [[one.setdefault(w, w) for w in t.split("\n") if w] for t in frame["words"]]
        return pd.DataFrame({"model": [pickle.dumps(train(bags, frame["toxic"].tolist(), seed=seed, **how))]})

    # Trained by one task on an executor; the driver gets one weight per triple.
    bags = map_text(sample, "__text", "h bigint, toxic int, words string", bag)
    made = bags.groupBy().applyInPandas(learn, "model binary").collect()
    return pickle.loads(made[0][0]) if made else train([], [])


class _Scores(dict):
    def __init__(self, machine: Machine):
        super().__init__()
        self.machine = machine

    def learn(self, words: list[str]) -> None:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(set(words))
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.update(zip(part, self.machine.words(part).tolist()))


@lru_cache(maxsize=2)
def _scores(raw: bytes) -> _Scores:
    return _Scores(pickle.loads(raw))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """Adds score_col, the score of each text's most toxic word, in one pass without a shuffle; null for texts without words.

    Null and empty texts have no words.  Texts of any length are read whole;
    repeated rows are each scored.  A column called score_col is replaced; others pass through,
    whatever their names.  An empty table gives an empty table.
    """
    columns, at = positional(docs)
    kept = [(f"c{i}", n) for i, n in enumerate(docs.columns) if n != score_col]
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))
    text_at = at(text_col)
    same = dict(columns.dtypes)[text_at] == "string" and text_at in dict(kept)
    own = columns.select(*[c for c, _ in kept])
    source = own if same else columns.select(*[c for c, _ in kept], F.col(text_at).cast("string").alias("__text"))
    names = [c for c, _ in kept]
    schema = T.StructType([*own.schema, T.StructField("__score", T.DoubleType(), True)])

    def run(batch: pa.RecordBatch, lo: int, texts: list[str]) -> pa.RecordBatch:
        claim("toxicity", _scores.cache_clear)
        known = _scores(model.value)
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = split_words(t)
            counts[k] = len(own)
            words += own
        known.learn(words)
        values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        out = np.full(len(texts), np.nan)
        full = counts > 0
        if full.any():
            out[full] = np.maximum.reduceat(values, (np.cumsum(counts) - counts)[full])
        column = pa.array(out, mask=~full)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], column], names=[*names, "__score"])

    return map_text(source, text_at if same else "__text", schema, run).toDF(*[n for _, n in kept], score_col)


def toxic_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs found toxic: id_col, toxic (true), toxicity.

    The machine is trained on the labels (see fit) and applied to every row,
    labelled or not.  Rows without words are not toxic; texts of any length are read whole.
    Null ids are scored as others; ids may be of any type that labels have too.  Repeated rows are each
    reported, and scores that tie are as they are: a row at the cut is toxic.  Other columns are ignored, whatever their names.
    Without labels of both classes, or for an empty table, the result is empty.
    """
    machine = fit(docs, labels, text_col, id_col, **how)
    found = score(narrowed(docs, [id_col], text_col)[0], machine, "t").where(F.col("toxicity") >= F.lit(machine.cut))
    return found.select(F.col("k0").alias(id_col), F.lit(True).alias("toxic"), "toxicity")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """docs without the rows found toxic, as toxic_documents() finds them; the columns are those of docs, whatever their names.

    Rows without words, of null or empty texts, stay; so do rows with a null id
    that aren't toxic.  Texts of any length are read whole.  Rows that repeat stay, or go,
    together.  Without labels of both classes all rows stay.  An empty table
    gives an empty table.
    """
    machine = fit(docs, labels, text_col, id_col, **how)
    names = docs.columns
    renamed, at = positional(docs)
    kept = score(renamed, machine, at(text_col), "__toxicity")  # the columns are c0, c1, ... here
    clean = F.col("__toxicity").isNull() | (F.col("__toxicity") < F.lit(machine.cut))
    return kept.where(clean).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])

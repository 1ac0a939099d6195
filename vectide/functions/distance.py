"""Distances between vectors as columns; lower is nearer.

Products are summed as doubles (exact for 32-bit components up to rounding of
the sum) and stay inside generated code: a vector that is known when the query
is planned becomes literals, its norm is computed here, once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import metric_name

#: Longest vectors whose sums are written out term by term; generated methods have a size limit.
UNROLLED = 192


def _total(terms: list[Column]) -> Column:
    """Sum as a balanced tree, so that expressions stay shallow."""
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i)).cast("double")


def _fold(v: Column, w: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda a, b: term(a.cast("double"), b.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _pair(v: Column, w: Column, term: Callable[[Column, Column], Column], n: int | None) -> Column:
    if n is not None and n <= UNROLLED:
        return _total([term(_at(v, i), _at(w, i)) for i in range(n)])
    return _fold(v, w, term)


def _with_literal(v: Column, query: Sequence[float], term: Callable[[Column, Column], Column]) -> Column:
    if len(query) <= UNROLLED:
        return _total([term(_at(v, i), F.lit(q)) for i, q in enumerate(query)])
    return _fold(v, F.array(*[F.lit(q) for q in query]), term)


def _cosine(dot: Column, norms: Column) -> Column:
    return F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - dot / norms)


def float32(query: Sequence[float]) -> list[float]:
    """The components as 32-bit floats, which is what collections hold."""
    return [float(x) for x in np.asarray(query, np.float32)]


def cosine_to(v: Column, query: Sequence[float]) -> Column:
    """1 - cos; 1 where either vector is zero."""
    q = float32(query)
    norm = math.sqrt(sum(x * x for x in q))
    if norm == 0:
        return F.lit(1.0)
    own = F.sqrt(_pair(v, v, lambda a, b: a * b, len(q)))
    return _cosine(_with_literal(v, q, lambda a, b: a * b), own * F.lit(norm))


def euclidean_to(v: Column, query: Sequence[float]) -> Column:
    return F.sqrt(_with_literal(v, float32(query), lambda a, b: (a - b) * (a - b)))


def dot_to(v: Column, query: Sequence[float]) -> Column:
    """The negated inner product."""
    return -_with_literal(v, float32(query), lambda a, b: a * b)


def cosine(v: Column, w: Column, n: int | None = None) -> Column:
    return _cosine(_pair(v, w, lambda a, b: a * b, n), F.sqrt(_pair(v, v, lambda a, b: a * b, n)) * F.sqrt(_pair(w, w, lambda a, b: a * b, n)))


def euclidean(v: Column, w: Column, n: int | None = None) -> Column:
    return F.sqrt(_pair(v, w, lambda a, b: (a - b) * (a - b), n))


def dot(v: Column, w: Column, n: int | None = None) -> Column:
    return -_pair(v, w, lambda a, b: a * b, n)


TO_LITERAL: dict[str, Callable[[Column, Sequence[float]], Column]] = {"cosine": cosine_to, "euclidean": euclidean_to, "dot": dot_to}
BETWEEN: dict[str, Callable[..., Column]] = {"cosine": cosine, "euclidean": euclidean, "dot": dot}


def distance_to(v: Column, query: Sequence[float], metric: str) -> Column:
    """Distance of a vector column to a known vector."""
    return TO_LITERAL[metric_name(metric)](v, query)


def distance(v: Column, w: Column, metric: str, n: int | None = None) -> Column:
    """Distance between two vector columns, of n components each if that is known."""
    return BETWEEN[metric_name(metric)](v, w, n)


def distances(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """All distances between rows of two matrices, as doubles."""
    v, q = np.asarray(vectors, np.float64), np.asarray(queries, np.float64)
    if metric == "euclidean":
        out = np.empty((len(v), len(q)))
        for j, one in enumerate(q):
            out[:, j] = np.sqrt(((v - one) ** 2).sum(1))
        return out
    products = v @ q.T
    if metric == "dot":
        return -products
    norms = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
    return np.where(norms == 0, 1.0, 1.0 - products / np.where(norms == 0, 1.0, norms))


def _sums(terms: np.ndarray) -> np.ndarray:
    """Row sums, added from the first component to the last, as SQL does; the same for the same row, wherever it stands."""
    return np.add.accumulate(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def squares(vectors: np.ndarray) -> np.ndarray:
    """Squared lengths of a matrix's rows."""
    return _sums(vectors * vectors)


def pair_distances(vectors: np.ndarray, queries: np.ndarray, v_squares: np.ndarray, q_squares: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of two matrices of doubles, one by one, with their squares() given."""
    if metric == "euclidean":
        return np.sqrt(squares(vectors - queries))
    products = _sums(vectors * queries)
    if metric == "dot":
        return 0.0 - products
    norms = np.sqrt(v_squares * q_squares)
    return np.where(norms == 0, 1.0, 1.0 - np.clip(products / np.where(norms == 0, 1.0, norms), -1.0, 1.0))

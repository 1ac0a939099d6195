"""What a collection is: its configuration, the columns of its rows, and checks of what comes in."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from .errors import DimensionMismatch, EmptyVector, EngineError

METRICS = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot": "dot", "dot_product": "dot", "dotproduct": "dot", "ip": "dot"}
DEFAULT_METRIC, DEFAULT_INDEX = "cosine", "flat"
INDEXES = {"flat": "flat", "hnsw": "hnsw"}

#: seq orders the writes of one id; the last wins.
ROWS = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("vector", T.ArrayType(T.FloatType(), True), True),
        T.StructField("metadata", T.VariantType(), True),
        T.StructField("document", T.StringType(), True),
        T.StructField("seq", T.LongType(), True),
    ]
)


def metric_name(text: str) -> str:
    """Canonical name of a metric; case doesn't matter."""
    try:
        return METRICS[text.lower()]
    except KeyError:
        raise EngineError(f"unknown metric: '{text}' (one of: {', '.join(METRICS)})") from None


def index_name(text: str) -> str:
    """Canonical name of an index kind; case doesn't matter."""
    try:
        return INDEXES[text.lower()]
    except KeyError:
        raise EngineError(f"unknown index: '{text}' (one of: {', '.join(INDEXES)})") from None


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int
    metric: str = "cosine"
    index: str = "flat"

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.\-]{0,199}", self.name):
            raise EngineError(f"invalid collection name: {self.name!r}")
        if self.dimension < 1:
            raise EmptyVector
        object.__setattr__(self, "metric", metric_name(self.metric))
        object.__setattr__(self, "index", index_name(self.index))

    def to_dict(self) -> dict:
        return asdict(self)


def check_vector(vector: Sequence[float], dimension: int) -> list[float]:
    """The vector as floats; empty, of another dimension, or not finite: an error."""
    out = [float(x) for x in vector]
    if len(out) != dimension:
        raise DimensionMismatch(dimension, len(out))
    if not out:
        raise EmptyVector
    if not all(map(math.isfinite, out)):
        raise EngineError("vector has a component that is not finite")
    return out


def check_top_k(top_k: int) -> int:
    if top_k < 0:
        raise EngineError("top_k must not be negative")
    return int(top_k)

"""Flat vector files and the row tables beside them, read and written for exchange with single-machine stores.

A vector file is a header of 16 bytes (four of a mark, dimension and count as
little-endian 32-bit integers, four unused) and then count x dimension 32-bit
floats.  The row table is SQLite: entries(id, vector_idx, metadata, document).
"""

from __future__ import annotations

import sqlite3
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, StorageError

MARK = bytes.fromhex("56455856")
HEADER, HEADER_SIZE = "<4sII4x", 16


def parse_header(raw: bytes) -> tuple[int, int]:
    """(dimension, count); short, foreign or truncated files are errors."""
    if len(raw) < HEADER_SIZE:
        raise StorageError("vector file is too short")
    mark, dimension, count = struct.unpack_from(HEADER, raw)
    if mark != MARK:
        raise StorageError("not a vector file: wrong mark")
    if len(raw) < HEADER_SIZE + 4 * dimension * count:
        raise StorageError("vector file is truncated")
    return dimension, count


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(idx, vector) of one or more vector files, each parsed where it is read."""
    found = spark.read.format("binaryFile").load(path).select("content")

    def parse(frames):
        for frame in frames:
            for content in frame["content"]:
                dimension, count = parse_header(content)
                m = np.frombuffer(content, "<f4", dimension * count, HEADER_SIZE).reshape(count, dimension)
                for lo in range(0, count, 10_000):
                    part = m[lo : lo + 10_000]
                    yield pd.DataFrame({"idx": np.arange(lo, lo + len(part)), "vector": list(part)})

    return found.mapInPandas(parse, "idx bigint, vector array<float>")


def write_vectors(path: str, vectors: np.ndarray) -> None:
    """A vector file on the driver's disk."""
    m = np.asarray(vectors, "<f4")
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, MARK, m.shape[1], m.shape[0]))
        f.write(m.tobytes())


def append_vectors(path: str, vectors: np.ndarray) -> list[int]:
    """Adds vectors to a file and returns their places."""
    m = np.atleast_2d(np.asarray(vectors, "<f4"))
    with open(path, "r+b") as f:
        dimension, count = parse_header(f.read())
        if m.shape[1] != dimension:
            raise DimensionMismatch(dimension, m.shape[1])
        f.seek(HEADER_SIZE + 4 * dimension * count)
        f.write(m.tobytes())
        f.seek(0)
        f.write(struct.pack(HEADER, MARK, dimension, count + len(m)))
    return list(range(count, count + len(m)))


def get_vector(path: str, idx: int) -> list[float] | None:
    """The vector at a place, None beyond the last."""
    with open(path, "rb") as f:
        dimension, count = parse_header(f.read())
        if not 0 <= idx < count:
            return None
        f.seek(HEADER_SIZE + 4 * dimension * idx)
        return np.frombuffer(f.read(4 * dimension), "<f4").tolist()


def import_rows(spark: SparkSession, vectors: str, table: str) -> DataFrame:
    """(id, vector, metadata, document) of a vector file and the SQLite file beside it (on the driver's disk)."""
    with sqlite3.connect(f"file:{table}?mode=ro", uri=True) as db:
        rows = db.execute("SELECT id, vector_idx, metadata, document FROM entries ORDER BY rowid").fetchall()
    entries = spark.createDataFrame(rows, "id string, idx bigint, metadata string, document string")
    joined = entries.join(read_vectors(spark, vectors), "idx")
    return joined.select("id", "vector", F.parse_json("metadata").alias("metadata"), "document")

"""Operator 8, token-id output: every document's ids compressed by itself with one shared zstandard dictionary."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import claim, map_text, narrowed
from .bpe import DEFAULT_VOCAB, forget_tiktoken, ship_vocab, tiktoken_ids
from .shingles import mix64

#: Ids between two entries of a document's offset index.
INDEX_EVERY = 4096


def serialise(ids: np.ndarray) -> bytes:
    """Little-endian uint32, all first bytes before all second ones and so on: alike bytes lie together."""
    return np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def parse(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _ids(texts: list[str], vocab: bytes) -> list[np.ndarray]:
    return [np.array(tiktoken_ids(t, vocab), np.int64) for t in texts]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True)


@lru_cache(maxsize=4)
def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def dictionary_hash(dictionary: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(dictionary)


def train_dictionary(docs: DataFrame, text_col: str = "text", vocab: str = DEFAULT_VOCAB, samples: int = 2000, frames: int = 8, size: int = 64 << 10, seed: int = 7) -> bytes:
    """A zstandard dictionary fitted on the id arrays of a sample: `frames` frames of each of `samples` distinct texts.

    The texts are those of the least seeded hashes among what about four times
    `samples` rows hold, and of long ones those frames are taken whose numbers hash lowest.  The bounds are
    parameters since a dictionary is a model of 64 KB; they change sizes, never
    results.  One task on an executor trains; the driver gets the dictionary.  Where
    there is too little to train on it is empty, and frames are compressed
    without one.
    """
    hashed = narrowed(docs, [], text_col)[0].select(F.xxhash64("t", F.lit(seed)).alias("h"), "t").where(F.length("t") > 0)
    share = min(1.0, 4 * samples / max(1, docs.count()))
    below = hashed.where(F.col("h") <= F.lit(min((1 << 63) - 1, int((share * 2 - 1) * (1 << 63)))).cast("bigint"))
    sample = below.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(samples)
    raw = ship_vocab(docs.sparkSession, vocab)

    def train(batches):
        import zstandard

        arrays: list[bytes] = []
        for batch in batches:
            for ids in _ids(batch.column(0).to_pylist(), raw.value):
                starts = np.arange(0, len(ids), INDEX_EVERY)
                chosen = starts[np.sort(np.argsort(mix64(starts.astype(np.uint64) + np.uint64(seed)), kind="stable")[:frames])]
                arrays += [serialise(ids[i : i + INDEX_EVERY]) for i in chosen.tolist()]
        try:
            made = zstandard.train_dictionary(min(size, max(1024, sum(map(len, arrays)) // 8)), arrays, level=3).as_bytes() if arrays else b""
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    found = sample.repartition(1).sortWithinPartitions("h").select("t").mapInArrow(train, "dictionary binary").collect()
    return max((bytes(r[0]) for r in found), key=len, default=b"")


def pack(ids: np.ndarray, dictionary: bytes, level: int = 3) -> tuple[bytes, list[int]]:
    """(frames of INDEX_EVERY ids each, one after another; the byte at which each begins)."""
    out, index, at = [], [], 0
    compress = _compressor(dictionary, level).compress
    for lo in range(0, len(ids), INDEX_EVERY):
        frame = compress(serialise(ids[lo : lo + INDEX_EVERY]))
        index.append(at)
        out.append(frame)
        at += len(frame)
    return b"".join(out), index


def unpack(payload: bytes, index: list[int], dictionary: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a packed document; only the frames that hold them are decompressed."""
    ends = [*index[1:], len(payload)]
    last = len(index) if stop is None else min(len(index), -(-stop // INDEX_EVERY))
    first = min(start // INDEX_EVERY, last)
    read = _decompressor(dictionary).decompress
    parts = [parse(read(payload[index[k] : ends[k]])) for k in range(first, last)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    base = first * INDEX_EVERY
    return ids[max(0, start - base) : None if stop is None else max(0, stop - base)]


def token_store(docs: DataFrame, text_col: str = "text", vocab: str = DEFAULT_VOCAB, dictionary: bytes | None = None, level: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs as (columns of `keep`, n_tokens, payload, frame_offsets, dict_hash), in one pass without a shuffle.

    payload holds zstandard frames of INDEX_EVERY ids, so that a short document
    is one frame, read by itself; frame_offsets tell where each begins, for
    reading part of a long one.  All frames need the dictionary whose hash is
    dict_hash.  Without a dictionary one is trained (see train_dictionary).
    Null and empty texts have no frame; texts of any length are stored whole;
    repeated rows are stored each, and there are no ties to break; an empty table gives an empty table.  Columns of `keep` that are
    called like a result are replaced by it.
    """
    names = ["n_tokens", "payload", "frame_offsets", "dict_hash"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in names]
    spark = docs.sparkSession
    if dictionary is None:
        dictionary = train_dictionary(docs, text_col, vocab)
    raw, shared, digest = ship_vocab(spark, vocab), spark.sparkContext.broadcast(dictionary), dictionary_hash(dictionary)
    narrow, kept = narrowed(docs, keep, text_col)
    types = (T.LongType(), T.BinaryType(), T.ArrayType(T.IntegerType()), T.StringType())
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in zip(names, types))])

    def run(batch: pa.RecordBatch, lo: int, texts: list[str]) -> pa.RecordBatch:
        claim("tiktoken", forget_tiktoken)
        arrays = _ids(texts, raw.value)
        packed = [pack(a, shared.value, level) for a in arrays]
        columns = [
            pa.array([len(a) for a in arrays], pa.int64()),
            pa.array([p for p, _ in packed], pa.binary()),
            pa.array([i for _, i in packed], pa.list_(pa.int32())),
            pa.array([digest] * len(texts), pa.string()),
        ]
        return pa.RecordBatch.from_arrays(batch.columns[:-1] + columns, names=[*keep, *names])

    return map_text(narrow, "t", schema, run)


def read_tokens(stored: DataFrame, dictionary: bytes) -> DataFrame:
    """Adds token_ids, the ids of each stored row; a row written with another dictionary raises."""
    shared, digest = stored.sparkSession.sparkContext.broadcast(dictionary), dictionary_hash(dictionary)

    @F.pandas_udf("array<int>")
    def ids(payload, index, found):
        if not found.eq(digest).all():
            raise ValueError("stored with another dictionary")
        import pandas as pd

        return pd.Series([unpack(bytes(p), list(i), shared.value).astype(np.int32) for p, i in zip(payload, index)])

    return stored.withColumn("token_ids", ids("payload", "frame_offsets", "dict_hash"))

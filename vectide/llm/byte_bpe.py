"""Operator 6, byte-level BPE encoding and decoding: vectorised pre-tokenisation and cached pair merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import claim, map_text, narrowed
from .bpe import DEFAULT_VOCAB, id_cache, ship_vocab, vocab_bytes
from .pretok import pretokenise, split_long


def _gather(starts: np.ndarray, lens: np.ndarray, source: np.ndarray) -> np.ndarray:
    """source[s : s + n] of every (s, n), one after another."""
    ends = np.cumsum(lens)
    at = np.ones(int(ends[-1]) if len(ends) else 0, np.int32)
    full = lens > 0
    s, n, e = starts[full], lens[full], ends[full]
    if len(s):
        at[0] = s[0]
        at[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return source[np.cumsum(at, dtype=np.int64)]


def decode_ids(ids: np.ndarray, raw: bytes) -> bytes:
    """The bytes of a run of ids; ids outside the vocabulary raise."""
    data, starts, lens = vocab_bytes(raw)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(lens)):
        raise ValueError("token id outside the vocabulary")
    return _gather(starts[ids], lens[ids], data).tobytes()


def encode_texts(texts: list[str], raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, where each token begins in its text's UTF-8 bytes, number of ids of each text)."""
    cache = id_cache(raw)
    parts = [split_long(t, 1_000_000) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    pieces, counts = pretokenise([p for ps in parts for p in ps])
    coded = list(map(cache.__getitem__, pieces))
    ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
    per_piece = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
    total = np.concatenate([[0], np.cumsum(per_piece)])
    ends = np.cumsum(counts)[np.cumsum(sizes) - 1] if len(parts) else np.zeros(0, np.int64)
    edges = total[np.concatenate([[0], ends])]
    per_text = np.diff(edges)
    lens = vocab_bytes(raw)[2][ids]
    offsets = np.cumsum(lens) - lens
    first = np.append(offsets, 0)[edges[:-1]]
    return ids, offsets - np.repeat(first, per_text), per_text


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, text_col: str = "text", vocab: str = DEFAULT_VOCAB, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs as (columns of `keep`, token_ids, token_offsets, round_trip), in one pass without a shuffle.

    token_offsets are the first bytes of the tokens in the text's UTF-8 form;
    round_trip says that decoding the ids gave the text's very bytes.  Null and
    empty texts give empty arrays and true; texts of any length are encoded
    whole; repeated rows are each encoded; an empty table gives an empty table.
    Columns of `keep` that are called like a result are replaced by it.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("token_ids", "token_offsets", "round_trip")]
    raw = ship_vocab(docs.sparkSession, vocab)
    narrow, kept = narrowed(docs, keep, text_col)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*kept, T.StructField("token_ids", ints), T.StructField("token_offsets", ints), T.StructField("round_trip", T.BooleanType())])

    def run(batch: pa.RecordBatch, lo: int, texts: list[str]) -> pa.RecordBatch:
        claim("ids", id_cache.cache_clear)
        ids, offsets, per_text = encode_texts(texts, raw.value)
        same = decode_ids(ids, raw.value) == "".join(texts).encode("utf-8")
        if same:
            good = np.ones(len(texts), bool)
        else:
            cuts = np.concatenate([[0], np.cumsum(per_text)])
            good = np.array([decode_ids(ids[a:b], raw.value) == t.encode("utf-8") for t, a, b in zip(texts, cuts, cuts[1:])], bool)
        columns = [*batch.columns[:-1], _lists(ids, per_text), _lists(offsets, per_text), pa.array(good)]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "token_ids", "token_offsets", "round_trip"])

    return map_text(narrow, "t", schema, run)


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """Adds (or replaces) out_col, the text of an array of ids; bytes that aren't UTF-8 become U+FFFD; null gives null."""
    raw = ship_vocab(encoded.sparkSession, vocab)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else decode_ids(np.asarray(x, np.int64), raw.value).decode("utf-8", "replace"))

    return encoded.withColumn(out_col, text(F.col(f"`{ids_col}`")))

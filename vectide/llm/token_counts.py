"""Operator 1, token counts: heap-and-linked-list byte-pair merging, without identifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import claim, map_text, narrowed
from .bpe import DEFAULT_VOCAB, count_cache, ship_vocab
from .pretok import pretokenise, split_long


def count_texts(texts: list[str], raw: bytes) -> np.ndarray:
    """Tokens of each text; long texts are cut where their pieces are not affected."""
    cache = count_cache(raw)
    parts = [split_long(t, 1_000_000) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    pieces, counts = pretokenise([p for ps in parts for p in ps])
    per_piece = np.fromiter(map(cache.__getitem__, pieces), np.int64, len(pieces))
    ends = np.cumsum(counts)[np.cumsum(sizes) - 1] if len(parts) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(per_piece)])
    return np.diff(total[np.concatenate([[0], ends])])


def token_counts(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", vocab: str = DEFAULT_VOCAB, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the columns of `keep` and the number of byte-level BPE tokens of its text.

    One pass without a shuffle.  Null and empty texts have 0 tokens; texts of
    any length are counted whole; rows that repeat are counted each; an empty
    table gives an empty table.  Columns not in `keep` (doc_id by default) are
    dropped; should `keep` hold a column named as `out_col`, the count replaces it.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != out_col]
    raw = ship_vocab(docs.sparkSession, vocab)
    narrow, kept = narrowed(docs, keep, text_col)
    schema = T.StructType([*kept, T.StructField(out_col, T.LongType())])

    def count(batch: pa.RecordBatch, lo: int, texts: list[str]) -> pa.RecordBatch:
        claim("counts", count_cache.cache_clear)
        columns = [*batch.columns[:-1], pa.array(count_texts(texts, raw.value))]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, out_col])

    return map_text(narrow, "t", schema, count)

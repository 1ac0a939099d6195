"""Operator 4, chat formatting: whole conversations rendered, encoded once with offsets, and masked by turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import SLICE_CHARS, claim, positional
from .bpe import DEFAULT_VOCAB, id_cache, ship_vocab
from .byte_bpe import _lists, encode_texts

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"


def quiet(said: str) -> str:
    """What is said, with a blank put into marks of turns, so that no text can end its turn or begin another."""
    return said.replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>") if "<|im_" in said else said


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """(conversation as one text, sorted spans (first byte, end, role) of what each turn says, its end mark included)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{quiet(role)}{MIDDLE}", f"{quiet(text)}{TAIL}"
        start = at + len(head.encode("utf-8"))
        at = start + len(body.encode("utf-8"))
        spans.append((start, at, role))
        parts += [head, body]
    return "".join(parts), spans


def mask_tokens(offsets: np.ndarray, size: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens with a byte in one of the sorted, disjoint spans, by binary search.

    offsets are the tokens' first bytes, in order; size is where the last ends.
    """
    mask = np.zeros(len(offsets), np.int8)
    if not len(offsets) or not spans:
        return mask
    ends = np.append(offsets[1:], size)
    begin, end = np.array(spans, np.int64).T
    lo = np.searchsorted(ends, begin, "right")  # first token that ends beyond the span's start
    hi = np.searchsorted(offsets, end, "left")  # first token that begins at the span's end or later
    delta = np.zeros(len(offsets) + 1, np.int64)
    keep = hi > lo
    np.add.at(delta, lo[keep], 1)
    np.add.at(delta, hi[keep], -1)
    mask[np.cumsum(delta[:-1]) > 0] = 1
    return mask


def _slices(batch: pa.RecordBatch, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Runs of conversations of about `most` bytes of text."""
    turns = batch.column("turns")
    said = turns.values.field("text")
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(said), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    size = ends[turns.offsets.to_numpy()]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",), vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """One row per conversation: conv_id, token_ids, loss_mask (1 on the turns of `learn`), n_turns.

    Turns are ordered by (turn, role, text), nulls first, so that repeated turn
    numbers have one order; rows that repeat stay repeated.  A null role reads as
    'user', a null text as ''.  Marks of turns within a text or role are broken up
    by a blank (see quiet).  Rows without conv_id belong to no conversation
    and are left out.  Long conversations are encoded whole.  A conversation
    without a turn of `learn` has a mask of zeros.  An empty table gives an
    empty table; other columns are ignored.  One shuffle, by conv_id.
    """
    raw = ship_vocab(turns.sparkSession, vocab)
    columns, at = positional(turns)
    rows = columns.select(F.col(at("conv_id")).alias("conv_id"), F.struct(F.col(at("turn")).alias("turn"), F.col(at("role")).cast("string").alias("role"), F.col(at("text")).cast("string").alias("text")).alias("turn"))
    chats = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    ints = "array<int>"
    schema = chats.select("conv_id", F.lit(None).cast(ints).alias("token_ids"), F.lit(None).cast("array<tinyint>").alias("loss_mask"), F.lit(0).alias("n_turns")).schema
    wanted = frozenset(learn)

    def run(batches):
        for batch in batches:
            claim("ids", id_cache.cache_clear)
            for part in _slices(batch):
                chat = [[(t["role"] if t["role"] is not None else "user", t["text"] or "") for t in ts] for ts in part.column("turns").to_pylist()]
                done = [render(c) for c in chat]
                ids, offsets, counts = encode_texts([text for text, _ in done], raw.value)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                masks = [mask_tokens(offsets[a:b], len(text.encode("utf-8")), [(s, e) for s, e, r in spans if r in wanted]) for (text, spans), a, b in zip(done, cuts, cuts[1:])]
                mask = np.concatenate([np.zeros(0, np.int8), *masks])
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), _lists(ids, counts), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(mask)), pa.array([len(c) for c in chat], pa.int32())],
                    names=["conv_id", "token_ids", "loss_mask", "n_turns"],
                )

    return chats.mapInArrow(run, schema)

"""Byte-pair merging by heap and linked list, with caches of pieces that live as long as a Python worker."""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

from .pretok import WHITE

#: Public vocabulary of byte-level BPE as lines of "base64 rank".
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space that are taken out of what tiktoken's pattern sees: its look-ahead fails on a million and more.
LONG_WHITE = 100_000
#: Pieces in either of the two generations of a worker's cache.
CACHE_PIECES = 150_000
#: Pieces of up to so many bytes are encoded by looking through their pairs, longer ones by the heap.
SCAN_LENGTH = 32
#: Longer pieces aren't cached.
CACHE_LENGTH = 64


def ship_vocab(spark: SparkSession, path: str = DEFAULT_VOCAB):
    """The vocabulary file (under 1 MB, whatever the data) as a broadcast variable, so that executors need no file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=4)
def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=4)
def vocab_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all the tokens' bytes in one array, start of each id, length of each id; unused ids have length 0)."""
    ranks = parse_ranks(raw)
    size = max(ranks.values(), default=-1) + 1
    by_id = [b""] * size
    for token, i in ranks.items():
        by_id[i] = token
    lens = np.fromiter(map(len, by_id), np.int64, size)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lens) - lens, lens


@lru_cache(maxsize=4)
def tiktoken_encoding(raw: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=parse_ranks(raw), special_tokens={})


@lru_cache(maxsize=4)
def _piece_encoding(raw: bytes):
    """Takes the whole of a text as one piece."""
    import tiktoken

    return tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=parse_ranks(raw), special_tokens={})


@lru_cache(maxsize=1)
def _long_white() -> re.Pattern:
    white = "".join(map(chr, WHITE))
    return re.compile(f"(?<![{white}])[{white}]{{{LONG_WHITE},}}")


def forget_tiktoken() -> None:
    tiktoken_encoding.cache_clear()
    _piece_encoding.cache_clear()


def tiktoken_ids(text: str, raw: bytes) -> list[int]:
    """tiktoken's ids of a text with runs of white space of any length.

    A long run is a piece, less its last character if more text follows, to
    which that belongs; what comes before and after is cut as it would be whole.
    """
    encode = tiktoken_encoding(raw).encode_ordinary
    if len(text) < LONG_WHITE:
        return encode(text)
    out, at = [], 0
    for run in _long_white().finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encode(text[at : run.start()])
        out += _piece_encoding(raw).encode_ordinary(text[run.start() : end])
        at = end
    return out + encode(text[at:])


def _merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, list[bytes | None]]:
    """Pops the adjacent pair of lowest rank (leftmost of equals) until none is left.

    Returns (merges made, symbols by the position of their first byte, None where merged away).
    """
    n = len(piece)
    sym: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    prior = list(range(-1, n - 1))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    merges = 0
    while heap:
        r, i, width = pop(heap)
        left = sym[i]
        if left is None:
            continue
        j = after[i]
        if j >= n or len(left) + len(sym[j]) != width:  # one side has changed since
            continue
        merged = left + sym[j]
        if get(merged) != r:
            continue
        sym[i], sym[j] = merged, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            prior[k] = i
            pair = merged + sym[k]
            if (s := get(pair)) is not None:
                push(heap, (s, i, len(pair)))
        h = prior[i]
        if h >= 0:
            pair = sym[h] + merged
            if (s := get(pair)) is not None:
                push(heap, (s, h, len(pair)))
    return merges, sym


def count_piece(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a piece: its bytes less the merges made; no identifier is looked up."""
    return len(piece) - _merge(piece, ranks)[0]


def _merge_scan(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same symbols by looking for the least rank each time, which is quicker for few pairs."""
    get, none = ranks.get, 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        merged = parts[i] + parts[i + 1]
        parts[i] = merged
        del parts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(merged + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + merged, none)
    return parts


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) <= SCAN_LENGTH:
        return [ranks[s] for s in _merge_scan(piece, ranks)]
    return [ranks[s] for s in _merge(piece, ranks)[1] if s is not None]


class _Cache(dict):
    """Pieces to what is made of them; when full, what it holds becomes the older generation, from which hits come back."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.older: dict = {}

    def make(self, piece: bytes):
        raise NotImplementedError

    def __missing__(self, piece: str):
        value = self.older.pop(piece, None)
        if value is None:
            value = self.make(piece.encode("utf-8"))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.older = self.copy()
                self.clear()
            self[piece] = value
        return value


class CountCache(_Cache):
    def make(self, piece: bytes) -> int:
        return count_piece(piece, self.ranks)


class IdCache(_Cache):
    """Pieces to their ids as little-endian uint32 bytes."""

    def make(self, piece: bytes) -> bytes:
        return np.array(encode_piece(piece, self.ranks), "<u4").tobytes()


@lru_cache(maxsize=4)
def count_cache(raw: bytes) -> CountCache:
    return CountCache(parse_ranks(raw))


@lru_cache(maxsize=4)
def id_cache(raw: bytes) -> IdCache:
    return IdCache(parse_ranks(raw))

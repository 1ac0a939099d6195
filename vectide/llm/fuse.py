"""Binary fuse filters (three segments, 8-bit fingerprints): static sets of 64-bit keys, about 9 bits each, no false negatives."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .shingles import mix64

_U = np.uint64


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    span: int
    prints: bytes

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key put in, and for about 1 in 256 others."""
        if not self.prints:
            return np.zeros(len(keys), bool)
        h = _hash(keys, self.seed)
        table = np.frombuffer(self.prints, np.uint8)
        a, b, c = _places(h, self.segment, self.span)
        return _print(h) == table[a] ^ table[b] ^ table[c]


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.astype(_U) + _U(seed))


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)


def _places(h: np.ndarray, segment: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = ((h >> _U(32)) * _U(span)) >> _U(32)
    mask = _U(segment - 1)
    b = (a + _U(segment)) ^ ((h >> _U(18)) & mask)
    c = (a + _U(2 * segment)) ^ (h & mask)
    return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)


def build(keys: np.ndarray) -> FuseFilter:
    """A filter of the distinct keys; peeled in rounds, so that each round is a few vector operations."""
    keys = np.unique(np.asarray(keys).astype(_U))
    n = len(keys)
    if n == 0:
        return FuseFilter(0, 1, 0, b"")
    segment = min(1 << 18, 1 << int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3))))
    segments = max(1, -(-room // segment) - 2)
    span = segments * segment
    for attempt in range(100):
        seed = (attempt * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)
        h = _hash(keys, seed)
        places = np.stack(_places(h, segment, span))
        size = span + 2 * segment
        count = np.bincount(places.ravel(), minlength=size)
        which = np.zeros(size, np.int64)  # xor of the keys' numbers at each place
        for row in places:
            np.bitwise_xor.at(which, row, np.arange(n))
        done = np.zeros(n, bool)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(count == 1)
        while len(single):
            key, first = np.unique(which[single], return_index=True)
            at = single[first]
            rounds.append((key, at))
            done[key] = True
            for row in places:
                np.subtract.at(count, row[key], 1)
                np.bitwise_xor.at(which, row[key], key)
            near = np.unique(places[:, key])
            single = near[count[near] == 1]
        if done.all():
            table = np.zeros(size, np.uint8)
            prints = _print(h)
            for key, at in reversed(rounds):
                a, b, c = places[:, key]
                table[at] = 0
                table[at] = prints[key] ^ table[a] ^ table[b] ^ table[c]
            return FuseFilter(seed, segment, span, table.tobytes())
    raise RuntimeError("no seed gave a filter")

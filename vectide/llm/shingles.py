"""Shingles of words and their min-wise hashes, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words in a shingle.
WIDTH = 3
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: White space beyond ASCII, and scripts that set no space between words, whose characters each count as a word.
_WHITE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_UNSPACED = [(0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0)]
#: Bytes that are hashed at once, and on to where a word ends.
_PART = 1 << 21
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 20), base, _U)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def forget_powers() -> None:
    _powers.clear()


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point under 65,536: 1 white space, 2 a word by itself, 0 the rest."""
    table = np.zeros(1 << 16, np.uint8)
    table[_WHITE] = 1
    for lo, hi in _UNSPACED:
        table[lo:hi] = 2
    return table


def word_flags(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a word begins at this byte, one has ended before it, it begins a word of one character) for UTF-8 text that ends in white space.

    Words are set apart by white space; in scripts that have none, every character is one.
    """
    solid = ~_SPACE[data]
    alone = np.zeros(len(data), bool)
    apart = np.zeros(len(data), bool)
    for lead in (np.flatnonzero(data == 0xC2), np.flatnonzero(data >= 0xE0)):
        if not len(lead):
            continue
        b = [data[lead].astype(np.int64), *(data[lead + k].astype(np.int64) for k in (1, 2))]
        size = np.where(b[0] < 0xE0, 2, np.where(b[0] < 0xF0, 3, 4))
        cp = np.where(size == 2, (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63)
        kind = _kinds()[np.where(size == 4, 0, cp)]
        kind[(size == 4) & (b[0] == 0xF0) & (b[1] >= 0xA0)] = 2  # ideographs beyond the first plane
        for k in range(3):
            solid[(lead + k)[(kind == 1) & (k < size)]] = False
        alone[lead[kind == 2]] = True
        apart[(lead + size)[kind == 2]] = True
    apart |= alone
    before = np.concatenate([[False], solid[:-1]])
    return solid & (~before | apart), before & (~solid | apart), alone


def _parts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of some _PART bytes that end in white space."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + _PART)
        while hi < len(data):
            found = np.flatnonzero(_SPACE[data[hi : hi + _PART]])
            if len(found):
                hi += int(found[0]) + 1
                break
            hi = min(len(data), hi + _PART)
        yield lo, hi
        lo = hi


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the lower-cased texts, words of each text); see word_flags for what a word is."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    hashes, begins = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for lo, hi in _parts(data):
        begin, stop, _ = word_flags(data[lo:hi])
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
        sums = np.zeros(hi - lo + 1, _U)
        np.cumsum((data[lo:hi].astype(_U) + _U(1)) * _power(_BASE, hi - lo), out=sums[1:])
        hashes.append(mix64((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, hi - lo + 1)[starts]))
        begins.append(starts + lo)
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(begins), edges))


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's runs of `width` words, in order and with repeats; how many each text has).

    A text of fewer words, but at least one, is one shingle; a text without words has none.
    """
    words, m = word_hashes(texts)
    counts = np.where(m >= width, m - width + 1, (m > 0).astype(np.int64))
    first = np.cumsum(m) - m
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    have = np.repeat(np.minimum(m, width), counts)
    padded = np.concatenate([words, np.zeros(width, _U)])
    out = np.zeros(len(at), _U)
    for k in range(width):
        part = padded[at + k] * _U(pow(_BASE, 2 * k + 3, 1 << 64))
        out += part if k == 0 else np.where(have > k, part, _U(0))
    return mix64(out), counts


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    values, counts = shingles(texts, width)
    return [np.unique(x) for x in np.split(values, np.cumsum(counts)[:-1])] if len(texts) else []


@lru_cache(maxsize=8)
def permutations(number: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, number, dtype=_U) * _U(2) + _U(1), rng.integers(0, 1 << 63, number, dtype=_U)


def signatures(values: np.ndarray, counts: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Least value of each text's shingles under `number` multiply-shift hashes, as uint32; all ones without shingles."""
    out = np.full((len(counts), number), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        mult, add = permutations(number, seed)
        work = np.empty_like(values)
        for k in range(number):
            np.multiply(values, mult[k], out=work)
            np.add(work, add[k], out=work)
            out[full, k] = np.minimum.reduceat(work, starts) >> _U(32)
    return out


def band_keys(sigs: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per text and band of equally many hashes, different bands having different keys."""
    rows = sigs.shape[1] // bands
    keys = np.zeros((len(sigs), bands), _U)
    for b in range(bands):
        h = np.full(len(sigs), (b + 1) * 0xD6E8FEB86659FD93 % (1 << 64), _U)
        for r in range(rows):
            h = mix64(h ^ (sigs[:, b * rows + r].astype(_U) + _U(r)))
        keys[:, b] = h
    return keys


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values; 0 where either is empty."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int(np.count_nonzero(b[at] == a))
    return same / (len(a) + len(b) - same)

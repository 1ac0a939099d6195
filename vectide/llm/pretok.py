"""Vectorised pre-tokenisation for byte-level BPE, without a regular expression (classes are those of Unicode 16).

The public pattern of byte-level BPE vocabularies

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is an automaton of eight states over nine classes of characters, once two
look-aheads are folded into the classes (what follows an apostrophe, what
follows white space).  The functions from state to state that strings of
classes induce form a small finite monoid, so that a prefix scan needs only a
table of products: texts are laid out as blocks, all blocks are scanned side by
side, the totals of the blocks are chained, and every position then knows the
state before it and whether a piece begins there.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

from .unicode_classes import letters, numbers

SEP, L, N, P, SP, WM, WL, A1, A2 = range(9)
S_FREE, S_L, S_N, S_P, S_J, S_W, S_C1, S_C2 = range(8)
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLOCK = 256


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """Class of every code point before look-ahead: L, N, P, or WM for white space."""
    table = np.full(sys.maxunicode + 1, P, np.uint8)
    for runs, cls in ((letters(), L), (numbers(), N)):
        for lo, hi in runs.tolist():
            table[lo:hi] = cls
    table[WHITE] = WM
    return table


def _step(state: int, cls: int) -> tuple[int, int]:
    """(next state, 1 if a piece begins at this character)."""
    if cls == L:
        if state in (S_C1, S_C2):
            return (S_FREE if state == S_C1 else S_C1), 0
        return S_L, int(state not in (S_L, S_J))
    if cls == N:
        return S_N, int(state not in (S_N, S_J))
    if cls in (P, A1, A2):
        inside = state in (S_P, S_J)
        if cls == P or inside:
            return S_P, int(not inside)
        return (S_C1 if cls == A1 else S_C2), 1
    if cls == SP:
        return S_J, 1
    if cls == WM:
        return S_W, int(state != S_W)
    return S_FREE, 1  # SEP, WL


@lru_cache(maxsize=1)
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, products f then g, state reached, piece begins by state and class)."""
    gens = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    known: dict[tuple, int] = {}
    order: list[tuple] = []
    todo = list(dict.fromkeys([tuple(range(8)), *gens]))
    while todo:
        f = todo.pop()
        if f in known:
            continue
        known[f] = len(order)
        order.append(f)
        todo.extend(tuple(g[x] for x in f) for g in gens)
    product = np.array([[known[tuple(g[x] for x in f)] for g in order] for f in order], np.uint16)
    gen_id = np.array([known[g] for g in gens], np.uint16)
    reach = np.array(order, np.uint8)
    begins = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)], bool)
    return gen_id, product, reach, begins


def classify(cp: np.ndarray, seps: np.ndarray) -> np.ndarray:
    """Classes with look-ahead; seps are the positions of separators between texts."""
    cls = codepoint_classes()[cp]
    white = cls == WM
    white[seps] = False
    solid = np.ones(len(cp), bool)
    np.logical_not(white[1:], out=solid[:-1])
    solid[-1] = False
    solid[seps - 1] = False  # white space before the end of a text belongs to its run
    last = white & solid
    cls[last] = WL
    cls[last & (cp == 32)] = SP
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        ext = np.concatenate([cp, np.zeros(2, cp.dtype)])
        sep = np.zeros(len(ext), bool)
        sep[seps] = True
        sep[len(cp):] = True
        a, b = ext[quote + 1], ext[quote + 2]
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32)) & ~sep[quote + 1]
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        two &= ~sep[quote + 1] & ~sep[quote + 2]
        cls[quote[one]] = A1
        cls[quote[two & ~one]] = A2
    cls[seps] = SEP
    return cls


def piece_starts(cls: np.ndarray) -> np.ndarray:
    """True where a piece begins, by a blocked associative scan over transition functions."""
    gen_id, product, reach, begins = transition_monoid()
    n, k = len(cls), product.shape[0]
    blocks = -(-n // _BLOCK)
    padded = np.zeros(blocks * _BLOCK, np.uint8)
    padded[:n] = cls
    by_step = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
    flat = product.ravel()
    prefix = np.empty((_BLOCK, blocks), np.uint16)
    cols = gen_id[by_step]
    prefix[0] = cols[0]
    for j in range(1, _BLOCK):
        np.take(flat, prefix[j - 1].astype(np.intp) * k + cols[j], out=prefix[j])
    entry = np.zeros(blocks, np.uint8)
    state = 0
    for b, f in enumerate(prefix[-1].tolist()):
        entry[b] = state
        state = reach[f, state]
    before = np.empty((_BLOCK, blocks), np.uint8)
    before[0] = entry
    before[1:] = reach.ravel()[prefix[:-1].astype(np.intp) * 8 + entry]
    flags = begins.ravel()[before.astype(np.intp) * 9 + by_step]
    return flags.T.reshape(-1)[:n]


def pretokenise(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(pieces of all the texts in order, number of pieces of each text)."""
    pieces, _, counts = pretokenise_offsets(texts)
    return pieces, counts


def pretokenise_offsets(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As pretokenise, with each piece's first character counted within its text."""
    if not texts:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    seps = np.cumsum(lengths + 1) - 1
    starts = np.flatnonzero(piece_starts(classify(cp, seps)))
    ends = np.append(starts[1:], len(cp))
    real = np.ones(len(starts), bool)
    real[np.searchsorted(starts, seps)] = False
    starts, ends = starts[real], ends[real]
    pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    edges = np.searchsorted(starts, np.concatenate([[0], seps + 1]))
    counts = np.diff(edges)
    base = np.repeat(seps - lengths, counts)
    return pieces, starts - base, counts


def split_long(text: str, limit: int) -> list[str]:
    """Cuts where a letter is followed by a blank and a letter, so that the pieces stay the same."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = at + limit
        while (cut := text.find(" ", cut)) != -1:
            if text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha():
                break
            cut += 1
        if cut == -1:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out

"""Simple-8b word-aligned integer coding, encoded and decoded with numpy.

A 64-bit word is a 4-bit selector and 60 bits of equally wide values; the selector says how many. Of the
selectors whose width holds the next values the one with most values is taken. Values of 2^60 and more are
escapes: 0 stands in their place and (position, value) pairs follow the words of a block.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Fixed values: (values a word, bits a value) by selector; 240 and 120 are runs of zeros.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([c for c, _ in SELECTORS])


def _ahead(peak: np.ndarray, by: int) -> np.ndarray:
    """Larger of each value and that `by` places on."""
    out = peak.copy()
    if 0 < by < len(peak):
        np.maximum(peak[:-by], peak[by:], out=out[:-by])
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of uint64 values; escapes is (n, 2): position and value."""
    values = np.asarray(values, U64)
    n = len(values)
    big = np.flatnonzero(values >> U64(60))
    escapes = np.stack([big.astype(U64), values[big]], axis=1)
    if len(big):
        values = values.copy()
        values[big] = 0
    if not n:
        return np.empty(0, U64), escapes
    best = np.full(n, len(SELECTORS) - 1, np.int8)
    peak = values.astype(np.uint32) if int(values.max()) >> 32 == 0 else values
    spans, size = {1: peak}, 1  # largest value of the `size` values from each place on; beyond the end nothing
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        while size * 2 <= count:
            spans[size * 2] = _ahead(spans[size], size)
            size *= 2
        most = _ahead(spans[size], count - size)
        fits = most < (1 << bits)
        if not fits.any():
            break
        np.putmask(best, fits, s)
    step = _COUNT[best].tolist()
    starts, i = [], 0
    put = starts.append
    while i < n:
        put(i)
        i += step[i]
    at = np.array(starts)
    sel = best[at].astype(U64)
    words = sel << U64(60)
    padded = np.concatenate([values, np.zeros(240, U64)])
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.flatnonzero(sel == U64(s))):
            word = words[mine]
            for k in range(count):
                word |= padded[at[mine] + k] << U64(k * bits)
            words[mine] = word
    return words, escapes


def decode(words: np.ndarray, n: int, escapes: np.ndarray | None = None) -> np.ndarray:
    """The n values, all words of a selector at a time."""
    sel = (words >> U64(60)).astype(np.int64)
    counts = _COUNT[sel]
    ends = np.cumsum(counts)
    out = np.zeros(max(n, int(ends[-1]) if len(ends) else 0), U64)
    at = ends - counts
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.flatnonzero(sel == s)):
            mask = U64((1 << bits) - 1)
            for k in range(count):
                out[at[mine] + k] = (words[mine] >> U64(k * bits)) & mask
    if n > (int(ends[-1]) if len(ends) else 0):
        raise ValueError("the words hold fewer values")
    out = out[:n]
    if escapes is not None and len(escapes):
        out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out

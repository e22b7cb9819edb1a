"""Rabin rolling fingerprints and super-features of chunks, many chunks at once in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from quern.config import SketchParams

U64 = np.uint64


def _times_x8(v: int, poly: int) -> int:
    for _ in range(8):
        v <<= 1
        if v >> (poly.bit_length() - 1):
            v ^= poly
    return v


@lru_cache(4)
def window_tables(window: int, poly: int) -> np.ndarray:
    """(window, 256): byte b, k places back, adds b * x^(8k) mod the polynomial.

    The fingerprint is linear over GF(2), so it is the XOR of its window's entries."""
    out = np.zeros((window, 256), U64)
    power = [1 << i for i in range(8)]  # x^i, then times x^8 for every place
    for k in range(window):
        for b in range(256):
            v = 0
            for i in range(8):
                if b >> i & 1:
                    v ^= power[i]
            out[k, b] = v
        power = [_times_x8(v, poly) for v in power]
    return out


@lru_cache(4)
def pair_tables(window: int, poly: int) -> np.ndarray:
    """(pairs, 65536): two bytes at once, the nearer one in the low half; a byte of 0 adds nothing."""
    one = np.vstack([window_tables(window, poly), np.zeros((window % 2, 256), U64)])
    return (one[0::2, None, :] ^ one[1::2, :, None]).reshape(-1, 1 << 16)


#: Bytes whose fingerprints are found at once: their arrays stay in a core's cache.
BLOCK = 1 << 16


def rolling(raw: np.ndarray, place: np.ndarray, p: SketchParams) -> np.ndarray:
    """Fingerprints after every byte; place tells how far a byte is behind the start of its window's run."""
    tables = pair_tables(p.window, p.polynomial)
    words = raw.astype(np.uint16)
    words[1:] |= np.where(place[1:] > 0, raw[:-1], 0).astype(np.uint16) << 8
    fp = tables[0][words]
    for k in range(2, min(p.window, int(place.max()) + 1), 2):
        fp[k:] ^= tables[k // 2][np.where(place[k:] >= k, words[:-k], 0)]
    return fp


def subchunk_peaks(chunks: list[bytes], p: SketchParams) -> np.ndarray:
    """(chunks, sub-chunks): each sub-chunk's largest fingerprint; the last one takes the remainder, empty ones give 0."""
    n = p.subchunks
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    lengths = np.repeat(sizes[:, None] // n, n, axis=1)
    lengths[:, -1] += sizes % n
    flat = lengths.ravel()
    peaks = np.zeros(len(flat), U64)
    if raw := b"".join(chunks):
        starts = np.cumsum(flat) - flat
        some = np.flatnonzero(flat)
        place = np.arange(len(raw)) - np.repeat(starts, flat)
        peaks[some] = np.maximum.reduceat(rolling(np.frombuffer(raw, np.uint8), place, p), starts[some])
    return peaks.reshape(-1, n)


def super_features(chunks: list[bytes], p: SketchParams) -> list[list[int]]:
    """p.supers unsigned 64-bit values a chunk: the i-th largest peak of every group, hashed together by XXH64 (seed 0)."""
    out: list[list[int]] = []
    begun = held = 0
    for i, chunk in enumerate(chunks):
        held += len(chunk)
        if held < BLOCK and i + 1 < len(chunks):
            continue
        groups = np.sort(subchunk_peaks(chunks[begun : i + 1], p).reshape(-1, p.groups, p.supers), axis=2)[:, :, ::-1]
        rows = groups.transpose(0, 2, 1).astype("<u8").tobytes()
        wide = p.groups * 8
        values = [xxhash.xxh64_intdigest(rows[at : at + wide], 0) for at in range(0, len(rows), wide)]
        out.extend(values[at : at + p.supers] for at in range(0, len(values), p.supers))
        begun, held = i + 1, 0
    return out


def signed(values: list[int]) -> list[int]:
    """The same bits as signed longs, Spark's only 64-bit type."""
    return [v - (1 << 64) if v >> 63 else v for v in values]

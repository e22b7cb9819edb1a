"""Content-defined chunking by a gear hash.

Halving and rounding down again and again is rounding down once: behind its first bytes the hash is the whole part
of the sum of value / 2^distance, whatever the chunk's start. So all places at which a chunk may end are found at
once, in fixed point; the few whose fraction is too near 1 to round are worked out byte by byte when met."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np

from quern.config import ChunkParams


@lru_cache(8)
def gear_table(seed: int) -> tuple[int, ...]:
    """256 values below 2^31: the first four bytes of SHA-256 of "gear:<seed>:<byte>"."""
    return tuple(int.from_bytes(hashlib.sha256(f"gear:{seed}:{b}".encode()).digest()[:4], "little") >> 1 for b in range(256))


#: Bytes after which a hash no longer tells where it began, but for its rounding.
WARM = 64
#: Bytes hashed at once: the arrays stay in a core's cache.
BLOCK = 1 << 17
#: Fractions from here on may be 1: each of six sums rounds down, and what is beyond WARM bytes is less than one unit.
UNSURE = np.uint64((1 << 32) - 64)


def _places(data: bytes, gear: np.ndarray, masks: tuple[int, ...]) -> list[dict[int, bool]]:
    """For each mask the places at which a warm hash has none of its bits, in order, and whether that is sure."""
    raw = np.frombuffer(data, np.uint8)
    found: list[dict[int, bool]] = [{} for _ in masks]
    for begun in range(0, len(raw), BLOCK):
        lead = min(begun, WARM - 1)
        total = gear[raw[begun - lead : begun + BLOCK]]
        reach = 1
        while reach < WARM:
            before = total[:-reach] >> np.uint64(reach)
            total[reach:] += before
            reach *= 2
        total = total[lead:]
        unsure = (total & np.uint64(0xFFFFFFFF)) >= UNSURE
        whole = total >> np.uint64(32)
        for mask, places in zip(masks, found, strict=True):
            at = np.flatnonzero(((whole & np.uint64(mask)) == 0) | (unsure & (((whole + np.uint64(1)) & np.uint64(mask)) == 0)))
            places.update(zip((at + begun).tolist(), (~unsure[at]).tolist(), strict=True))
    return found


def cuts(data: bytes, p: ChunkParams, table: tuple[int, ...] | None = None) -> list[int]:
    """End offsets of the chunks of data, in order; none for no data.

    Within a chunk the hash starts at 0 behind the least size. It is halved and a byte's value added; a
    chunk ends after the byte at which the mask's bits are all 0, the strict mask first, then the loose one."""
    gear = table or gear_table(p.gear_seed)
    ends: list[int] = []
    at, n = 0, len(data)
    masks = (p.strict_mask, p.loose_mask)
    wide = min(n, p.most) > p.least + 4 * WARM  # else few places lie beyond the warm ones
    known = _places(data, np.array(gear, np.uint64) << np.uint64(32), masks) if wide else [{}, {}]
    orders = [list(k) for k in known]
    while n - at > p.least:
        begun, bound = at + p.least, min(at + p.most, n)
        stop, warm = min(max(at + p.strict_until, begun), bound), min(begun + WARM, bound) if wide else bound
        h, end, i = 0, 0, begun
        for mask, high in zip(masks, (min(stop, warm), warm), strict=True):
            for b in data[i:high]:
                h = (h >> 1) + gear[b]
                i += 1
                if not h & mask:
                    end = i
                    break
            if end:
                break
        if not end:
            for mask, places, order, low, high in zip(masks, known, orders, (warm, max(stop, warm)), (stop, bound), strict=True):
                if end := _first(data, gear, begun, mask, places, order, low, high):
                    break
        at = end or bound
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _first(data: bytes, gear: tuple[int, ...], begun: int, mask: int, places: dict[int, bool], order: list[int], low: int, high: int) -> int:
    """The end behind the first place of low..high - 1 that fits the mask in a hash begun at `begun`; 0 if none does."""
    k, h, read = bisect_left(order, low), 0, begun
    while k < len(order) and (i := order[k]) < high:
        if places[i]:
            return i + 1
        for b in data[read : i + 1]:
            h = (h >> 1) + gear[b]
        read = i + 1
        if not h & mask:
            return i + 1
        k += 1
    return 0

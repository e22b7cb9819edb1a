"""Copy/add delta coding of a chunk against a base.

Format: varint length of the chunk, then operations: a varint whose lowest bit tells copy (1: then a varint
offset in the base) from add (0: then the bytes), the rest the length. Matches are of four bytes or more.
"""

from __future__ import annotations

LEAST = 4


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read(data: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        if at >= len(data):
            raise ValueError("the delta ends early")
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def encode(base: bytes, data: bytes) -> bytes:
    """At each place the longest of the base's few first matches is taken, grown both ways."""
    places: dict[bytes, list[int]] = {}
    for i in range(len(base) - LEAST + 1):
        seen = places.setdefault(base[i : i + LEAST], [])
        if len(seen) < 8:
            seen.append(i)
    out = bytearray(_varint(len(data)))
    i = begun = 0
    n = len(data)

    def add(upto: int) -> None:
        if upto > begun:
            out.extend(_varint((upto - begun) << 1))
            out.extend(data[begun:upto])

    while i + LEAST <= n:
        best_at, best_n, best_back = 0, 0, 0
        for at in places.get(data[i : i + LEAST], ()):
            length = LEAST
            top = min(n - i, len(base) - at)
            while length < top and base[at + length] == data[i + length]:
                length += 1
            back = 0
            while back < i - begun and back < at and base[at - back - 1] == data[i - back - 1]:
                back += 1
            if length + back > best_n + best_back:
                best_at, best_n, best_back = at, length, back
        if not best_n:
            i += 1
            continue
        add(i - best_back)
        out.extend(_varint(((best_n + best_back) << 1) | 1))
        out.extend(_varint(best_at - best_back))
        i += best_n
        begun = i
    add(n)
    return bytes(out)


def decode(base: bytes, delta: bytes) -> bytes:
    size, at = _read(delta, 0)
    out = bytearray()
    while at < len(delta):
        op, at = _read(delta, at)
        n = op >> 1
        if op & 1:
            start, at = _read(delta, at)
            part = base[start : start + n]
        else:
            part = delta[at : at + n]
            at += n
        if len(part) != n:
            raise ValueError("the delta reaches beyond its base or end")
        out += part
    if len(out) != size:
        raise ValueError("the delta gives another length")
    return bytes(out)

"""Byte codecs: zstd, LZ4 and zlib with a raw fallback, padding, XOR."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
import zlib

_compressors: dict[int, zstandard.ZstdCompressor] = {}


def compress(data: bytes, level: int = -1, kind: str = "zstd") -> tuple[bytes, bool]:
    """(payload, compressed?): the data itself where compression gains nothing."""
    if kind == "zstd":
        if level not in _compressors:
            _compressors[level] = zstandard.ZstdCompressor(level=level)
        out = _compressors[level].compress(data)
    elif kind == "zlib":
        out = zlib.compress(data, level)
    elif kind == "lz4":  # a raw block behind its size, which such a block doesn't hold
        out = struct.pack("<I", len(data)) + pa.compress(data, codec="lz4_raw", asbytes=True)
    else:
        raise ValueError(f"no codec {kind!r}")
    return (out, True) if len(out) < len(data) else (data, False)


def decompress(payload: bytes, compressed: bool, kind: str = "zstd") -> bytes:
    if not compressed:
        return payload
    if kind == "lz4":
        return pa.decompress(payload[4:], struct.unpack("<I", payload[:4])[0], codec="lz4_raw", asbytes=True)
    return zstandard.ZstdDecompressor().decompress(payload) if kind == "zstd" else zlib.decompress(payload)


def padding_blocks(original: int, packed: int, seed: int, most: int) -> int:
    """4-byte blocks: (seed mod limit) / 4 and 1 at least, none if the limit is below 4."""
    limit = min(original - packed, most)
    return 0 if limit < 4 else max(1, seed % limit // 4)


def pad(packed: bytes, original: int, seed: int, most: int = 255, salt: bytes = b"") -> bytes:
    """packed, padding, and packed's size in the last four bytes. The padding follows from the seed alone, or from
    seed and salt: a salt of its own for each run makes it random."""
    n = 4 * padding_blocks(original, len(packed), seed, most)
    fill, i = b"", 0
    while len(fill) < n:
        fill += hashlib.sha256(salt + struct.pack("<qI", seed, i)).digest()
        i += 1
    return packed + fill[:n] + struct.pack("<I", len(packed))


def unpad(padded: bytes) -> bytes:
    return padded[: struct.unpack("<I", padded[-4:])[0]]


def xor(data: bytes, stream: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    return (a ^ np.frombuffer(stream, np.uint8, len(a))).tobytes()

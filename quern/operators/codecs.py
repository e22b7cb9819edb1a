"""Codecs over binary columns: Arrow-batched kernels, one value at a time inside a batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.kernels import codec, delta

_PACKED = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("packed", T.BooleanType())])


def compress(data: Column, level: int = -1, kind: str = "zstd") -> Column:
    """struct(payload, packed): the data itself, packed false, where compression gains nothing."""

    @F.pandas_udf(_PACKED)
    def kernel(s: pd.Series) -> pd.DataFrame:
        out = [(None, None) if b is None else codec.compress(b, level, kind) for b in s]
        return pd.DataFrame(out, columns=["payload", "packed"])

    return kernel(data)


def decompress(payload: Column, packed: Column, kind: str = "zstd") -> Column:
    @F.pandas_udf(T.BinaryType())
    def kernel(s: pd.Series, ok: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else codec.decompress(b, bool(k), kind) for b, k in zip(s, ok, strict=True)], dtype=object)

    return kernel(payload, packed)


def pad(payload: Column, original: Column, seed: Column, most: int = 255, salt: bytes = b"") -> Column:
    """Padded up to `original` bytes: the chunk's size, or the largest chunk's for a limit that doesn't depend on the chunk.

    seed: a number, or a binary digest, whose bytes are added up."""

    @F.pandas_udf(T.BinaryType())
    def kernel(s: pd.Series, n: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else codec.pad(b, int(k), sum(x) if isinstance(x, bytes | bytearray) else int(x), most, salt) for b, k, x in zip(s, n, seeds, strict=True)], dtype=object)

    return kernel(payload, original, seed)


def padding_bytes(original: Column, packed: Column, seed: Column, most: int = 255) -> Column:
    """Bytes that pad() adds before the size: in Catalyst, as the rule is arithmetic."""
    limit = F.least(original - packed, F.lit(most))
    return F.when(limit < 4, 0).otherwise(4 * F.greatest(F.lit(1), F.floor(F.pmod(seed, F.greatest(limit, F.lit(1))) / 4))).cast("int")


def unpad(padded: Column) -> Column:
    """The payload before its padding: in Catalyst."""
    tail = F.hex(F.substring(padded, -4, 4))
    at = lambda i: F.substring(tail, i, 2)
    size = F.conv(F.concat(at(7), at(5), at(3), at(1)), 16, 10).cast("int")
    return F.substring(padded, F.lit(1), size)


def xor(data: Column, stream: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else codec.xor(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return kernel(data, stream)


def delta_encode(base: Column, data: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else delta.encode(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return kernel(base, data)


def delta_decode(base: Column, coded: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else delta.decode(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return kernel(base, coded)

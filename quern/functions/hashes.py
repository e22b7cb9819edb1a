"""Hash and sketch expressions; all but the two kernels stay in Catalyst."""

from __future__ import annotations

import hashlib

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import SketchParams
from quern.kernels import features as _features

#: Fixed value: the pass phrase of the keyed digest.
HMAC_KEY = b"password"


def digest(data: Column, kind: str = "sha256") -> Column:
    """Lower-case hex digest of binary data."""
    if kind == "sha256":
        return F.sha2(data, 256)
    if kind == "sha1":
        return F.sha1(data)
    if kind == "md5":
        return F.md5(data)
    raise ValueError(f"no digest {kind!r}")


def hmac_sha256(data: Column, key: bytes = HMAC_KEY) -> Column:
    """Two nested digests over the padded key."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)


def dual_fingerprint(first: Column, second: Column) -> Column:
    """SHA-256 over the two SHA-256 digests."""
    return F.sha2(F.concat(F.unhex(F.sha2(first, 256)), F.unhex(F.sha2(second, 256))), 256)


def byte_sum(hex_digest: Column, size: int = 32) -> Column:
    """Sum of a hex digest's bytes: the seed that padding uses."""
    byte = lambda i: F.conv(F.substring(hex_digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda a, i: a + byte(i))


def object_id(path: Column, client: Column) -> Column:
    """Name of a client's input in the store."""
    return F.sha2(F.encode(F.concat(path.cast("string"), client.cast("string")), "UTF-8"), 256)


def container_name(client: Column, number: Column) -> Column:
    """client:number (number alone for a null client): reruns agree, and no two containers share a name."""
    return F.concat_ws(":", client.cast("string"), number.cast("string"))


@F.pandas_udf(T.LongType())
def xxh64(data: pd.Series) -> pd.Series:
    """XXH64 with seed 0 (the built-in xxhash64() has seed 42), as a signed long."""
    return data.map(lambda b: None if b is None else _features.signed([xxhash.xxh64_intdigest(b, 0)])[0])


def super_features(data: Column, p: SketchParams) -> Column:
    """array<long> of p.supers Rabin super-features."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def kernel(s: pd.Series) -> pd.Series:  # not of iterators: Spark can't plan those over ciphers made in the same step
        found = iter(_features.super_features([b for b in s if b is not None], p))
        return s.map(lambda b: None if b is None else _features.signed(next(found)))

    return kernel(data)


def shingle_features(data: Column, supers: int = 3, groups: int = 4, width: int = 4) -> Column:
    """array<string> of super-features in SQL terms: sub-chunk peaks are the largest MD5 of `width`-byte shingles.

    Sub-chunks that are shorter than a shingle have the peak ''."""
    n = supers * groups
    size = F.floor(F.octet_length(data) / n).cast("int")

    def peak(i: Column) -> Column:
        start = i * size
        length = F.when(i == n - 1, F.octet_length(data) - start).otherwise(size)
        hashes = F.transform(F.sequence(F.lit(0), length - width), lambda j: F.md5(F.substring(data, start + j + 1, F.lit(width))))
        return F.when(length >= width, F.array_max(hashes)).otherwise(F.lit(""))

    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  a lambda's argument is computed once
    peaks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), peak)
    ranked = lambda p: F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.reverse(F.sort_array(F.slice(p, g * supers + 1, F.lit(supers)))))
    row = lambda r, i: F.md5(F.encode(F.array_join(F.transform(r, lambda x: F.element_at(x, i)), ""), "UTF-8"))
    return once(peaks, lambda p: once(ranked(p), lambda r: F.transform(F.sequence(F.lit(1), F.lit(supers)), lambda i: row(r, i))))


def div_ceil(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)

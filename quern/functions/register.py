"""The kernels as SQL functions and a table function of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import ReductionConfig
from quern.kernels import cdc, codec, delta, features
from quern.ship import ship


def register(spark: SparkSession, cfg: ReductionConfig = ReductionConfig(), prefix: str = "quern_") -> list[str]:
    """quern_cut_points, quern_super_features, quern_compress, quern_delta, quern_undelta and the table function quern_chunks."""
    ship(spark)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cut_points(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else cdc.cuts(b, cfg.chunk))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def super_features(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else features.signed(features.super_features([b], cfg.sketch)[0]))

    @F.pandas_udf(T.BinaryType())
    def compress(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else codec.compress(b, cfg.zstd_level)[0])

    @F.pandas_udf(T.BinaryType())
    def encode(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else delta.encode(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    @F.pandas_udf(T.BinaryType())
    def decode(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else delta.decode(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    @F.udtf(returnType="chunk_no: int, start: int, size: int, data: binary")
    class Chunks:
        def eval(self, content: bytes) -> Iterator[tuple]:
            at = 0
            for i, end in enumerate(cdc.cuts(content or b"", cfg.chunk)):
                yield i, at, end - at, content[at:end]
                at = end

    made = {"cut_points": cut_points, "super_features": super_features, "compress": compress, "delta": encode, "undelta": decode}
    for name, f in made.items():
        spark.udf.register(prefix + name, f)
    spark.udtf.register(f"{prefix}chunks", Chunks)
    return sorted([*(prefix + n for n in made), f"{prefix}chunks"])

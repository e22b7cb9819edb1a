"""Chunking: rows (object, content) to rows (object, chunk_no, start, size, data).

Cases: null and empty contents have no chunk; repeated rows are chunked each; columns of an object that are
named like a chunk's give way to the chunk's; all others are kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import ChunkParams, ReductionConfig
from quern.kernels import cdc
from quern.ship import ship
from quern.tables import fresh, once, spread


#: Columns that a chunk has besides those of its object; an object's columns of these names give way.
COLUMNS = ("chunk_no", "start", "size", "data")


def fixed(objects: DataFrame, size: int, content: str = "content") -> DataFrame:
    """Chunks of `size` bytes, the last one shorter; an empty object has none. All in Catalyst."""
    n = F.octet_length(content)
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size).cast("long")), lambda i: i * size)
    return _cut(objects.where(n > 0), objects, content, F.transform(starts, lambda a: F.struct(a.alias("a"), F.least(a + size, n).alias("b"))))


def cut_points(content: Column, p: ChunkParams) -> Column:
    """array<int> of chunk ends."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = cdc.gear_table(p.gear_seed)
        for s in batches:
            yield s.map(lambda b: [] if b is None else cdc.cuts(b, p, table))

    return kernel(content)


def content_defined(objects: DataFrame, p: ChunkParams = ChunkParams(), content: str = "content") -> DataFrame:
    """Chunks at content-defined cut points: Python finds the offsets, Catalyst cuts the bytes."""
    ship(objects.sparkSession)
    ends = fresh("_ends", objects.columns)
    found = spread(objects.where(F.octet_length(content) > 0)).withColumn(ends, cut_points(F.col(content), p))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return _cut(found, objects, content, F.arrays_zip(starts.alias("a"), F.col(ends).alias("b")))


def _cut(rows: DataFrame, objects: DataFrame, content: str, places: Column) -> DataFrame:
    """A row for each place (a, b) of a row's content. The bytes are cut inside the array that is exploded: exploding
    places beside the content would copy the whole content onto each of its chunks."""
    keep = [c for c in objects.columns if c.lower() not in (content.lower(), *COLUMNS)]
    data = lambda c, x: F.substring(c, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))
    pieces = once(F.col(content), lambda c: F.transform(places, lambda x: F.struct(x["a"].cast("long").alias("start"), (x["b"] - x["a"]).cast("int").alias("size"), data(c, x).alias("data"))))
    at, piece = fresh("_at", keep), fresh("_piece", keep)
    return rows.select(*keep, F.posexplode(pieces).alias(at, piece)).select(*keep, F.col(at).cast("long").alias("chunk_no"), f"{piece}.start", f"{piece}.size", f"{piece}.data")


def chunk(objects: DataFrame, cfg: ReductionConfig, content: str = "content") -> DataFrame:
    """Chunks by the configured chunker. Of objects that come in parts of `read_bytes` (column part), places and
    numbers go on from part to part: numbers grow along the object, with gaps where a part ends."""
    made = fixed(objects, cfg.chunk.normal, content) if cfg.chunker == "fixed" else content_defined(objects, cfg.chunk, content)
    if "part" not in objects.columns:
        return made
    most = cfg.read_bytes // (cfg.chunk.normal if cfg.chunker == "fixed" else cfg.chunk.least) + 1
    part = F.col("part").cast("long")
    return made.withColumn("chunk_no", part * most + F.col("chunk_no")).withColumn("start", part * cfg.read_bytes + F.col("start")).drop("part")

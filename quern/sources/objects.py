"""Inputs as objects: (file_id, client, version, content)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import files as stored
from quern.config import ReductionConfig
from quern.functions.hashes import object_id
from quern.ship import ship
from quern.tables import numbered


def files(spark: SparkSession, path: str, client: str = "0", pattern: str | None = None, read_bytes: int = ReductionConfig.read_bytes) -> DataFrame:
    """(file_id, client, version, part, content, path): files in parts of read_bytes, a version each, in order of their
    names (as sorted names of backups are versions). No chunk spans two parts.

    A file of one part comes from Spark's reader; of larger ones each part is read by itself, from stores that
    executors reach by path. An empty file has no row, as it has no chunk."""
    ship(spark)
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    order = numbered(found.select("path").distinct(), ["path"], "version")
    one = found.where(F.col("length") <= read_bytes).select("path", F.lit(0).cast("long").alias("part"), "content")
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / read_bytes)))
    many = found.where(F.col("length") > read_bytes).select("path", ranges.alias("part")).repartition("path", "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, part in zip(b["path"].to_pylist(), b["part"].to_pylist(), strict=True):
                with stored.reading(name) as f:
                    f.seek(part * read_bytes)
                    yield pa.record_batch([[name], [part], [f.read(read_bytes)]], names=["path", "part", "content"])

    parts = one.unionByName(many.mapInArrow(read, "path string, part long, content binary"))
    named = parts.join(order, "path")
    return named.select(object_id(F.col("path"), F.lit(client)).alias("file_id"), F.lit(client).alias("client"), F.col("version").cast("int").alias("version"), "part", "content", "path")


def from_table(rows: DataFrame, key: Column, text: Column, client: Column, version: Column) -> DataFrame:
    """A row of a table as an object: its text in UTF-8 (null: empty)."""
    return rows.select(key.cast("string").alias("file_id"), client.cast("string").alias("client"), version.cast("int").alias("version"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("content"))


def documents(spark: SparkSession, sf_dir: str, versions: int = 4) -> DataFrame:
    """Documents as objects: a client is a language, a version a run of sources (src0 to src4 come first of four)."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id"), F.col("text"), F.coalesce("lang", F.lit("")), F.floor(number / F.lit(20 // versions)))


def rows_as_backups(rows: DataFrame, version: Column, key: Column, line: Column, keys: int = 4096) -> DataFrame:
    """Rows of a table, a line each in order of their keys, as backup objects: one for each version and run of `keys` keys.

    Where keys are unique an object has `keys` lines at most."""
    block = F.floor(key / keys).cast("long")
    some = rows.select(version.cast("int").alias("version"), block.alias("block"), F.struct(key.alias("key"), line.alias("line")).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["line"]), "\n")
    whole = some.groupBy("version", "block").agg(F.encode(body, "UTF-8").alias("content"))
    return whole.select(F.concat_ws(":", F.col("version").cast("string"), F.col("block").cast("string")).alias("file_id"), F.lit("0").alias("client"), "version", "content")

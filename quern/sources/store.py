"""The store on disk: recipes, keys, chunk addresses, containers and statistics as Parquet, CSV for logs.

Keys are a table of their own, so that whoever holds the rest holds no key. Recipes are partitioned by
version, so that restoring one reads one."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import files
from quern.ship import ship
from quern.tables import settle

TABLES = ("recipe", "keys", "addr", "containers")


class MissingObject(LookupError):
    """No recipe of that name."""


def save(result, path: str, mode: str = "overwrite") -> None:
    """Write a ReductionResult's tables below path."""
    for name in TABLES:
        writer = getattr(result, name).write.mode(mode)
        (writer.partitionBy("version") if name == "recipe" else writer).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    found = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    found["recipe"] = found["recipe"].withColumn("file_id", F.col("file_id").cast("string"))
    return found


def require(recipe: DataFrame, file_ids: list[str]) -> None:
    """Every name must have a recipe."""
    asked = recipe.sparkSession.createDataFrame([(i,) for i in sorted(set(file_ids))], "file_id string")
    missing = asked.join(recipe.select("file_id").distinct(), "file_id", "left_anti").orderBy("file_id").limit(10).collect()
    if missing:
        raise MissingObject(", ".join(r[0] for r in missing))


def upsert_index(stored: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """A key-value index after new rows: new ones replace stored ones of their key."""
    return new if stored is None else stored.join(new.select(key), key, "left_anti").unionByName(new)


def write_log(stats: DataFrame, path: str, mode: str = "append") -> None:
    """Statistics as CSV with a header."""
    stats.write.mode(mode).option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def totals(log: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Running totals over the rows of a log, whatever runs wrote them: what counters kept between runs would hold."""
    order = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)  # a row for each run
    return log.select(by, *[F.sum(c).over(order).cast("long").alias(c) for c in columns])


def write_objects(chunks: DataFrame, path: str, suffix: str = "-d") -> DataFrame:
    """Restored chunks (client, version, file_id, chunk_no, data) as files below path: (path, size) of each.

    A task writes a file chunk by chunk, so files may be of any size. Executors write, so path must be one that
    they share. A file appears under its name only when complete."""
    ship(chunks.sparkSession)
    schema = pa.schema([("path", pa.string()), ("size", pa.int64())])
    names = ["client", "version", "file_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in (*names, "data")), strict=True))
        for (client, version, file_id), own in groupby(rows, key=lambda r: r[:3]):
            name, size = f"{path}/{client}/{version}/{file_id}{suffix}", 0
            with files.replacing(name) as f:
                for r in own:
                    size += f.write(r[3])
            yield pa.record_batch([[name], [size]], schema=schema)

    sorted_rows = chunks.select(*names, "chunk_no", "data").repartition(*names).sortWithinPartitions(*names, "chunk_no")
    return settle(sorted_rows.mapInArrow(run, "path string, size long"), "written")

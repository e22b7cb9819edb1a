"""Versions as a stream: every trigger takes what has arrived, state stays between triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.chunk import chunk
from quern.config import ReductionConfig
from quern.operators.dedup import against_index
from quern.ship import ship
from quern.tables import new_path


def unique_chunks(objects: DataFrame, cfg: ReductionConfig = ReductionConfig()) -> DataFrame:
    """A stream of objects to a stream of chunks, each fingerprint of a client once: keyed state, no payload in it."""
    chunks = chunk(objects, cfg).withColumn("fp", F.sha2("data", 256)).drop("data")
    return chunks.dropDuplicates(["client", "fp"])


def late_unique_chunks(objects: DataFrame, ts: str, delay: str, cfg: ReductionConfig = ReductionConfig()) -> DataFrame:
    """The same with an event time: fingerprints are forgotten `delay` after their time, as old versions are."""
    chunks = chunk(objects.withWatermark(ts, delay), cfg).withColumn("fp", F.sha2("data", 256)).drop("data")
    return chunks.dropDuplicatesWithinWatermark(["client", "fp"])


def replay(objects: DataFrame, schema: str, step, versions: list[int]) -> None:
    """Hand the versions to a stream one after another: step(stream, checkpoint) starts a query that ends by itself."""
    spark = objects.sparkSession
    box, state = new_path(spark, "arrivals"), new_path(spark, "state")
    for v in versions:
        objects.where(F.col("version") == v).write.mode("append").parquet(box)
        step(spark.readStream.schema(schema).parquet(box), state).awaitTermination()


OBJECT = "file_id string, client string, version int, content binary"


def stream_unique(objects: DataFrame, versions: list[int], cfg: ReductionConfig = ReductionConfig()) -> DataFrame:
    """Unique chunks of a client, found version by version with the state store."""
    spark = objects.sparkSession
    ship(spark)
    out = new_path(spark, "unique")

    def step(stream: DataFrame, state: str):
        return unique_chunks(stream, cfg).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()

    replay(objects.select("file_id", "client", "version", "content"), OBJECT, step, versions)
    return spark.read.parquet(out)


def stream_index(objects: DataFrame, versions: list[int], cfg: ReductionConfig = ReductionConfig()) -> DataFrame:
    """(version, new_chunks, new_bytes) by an index table that grows with every micro-batch.

    A batch is written under its own number, so that a batch that runs again replaces itself."""
    spark = objects.sparkSession
    ship(spark)
    index = new_path(spark, "index")

    def grow(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        rows = chunk(batch, cfg).withColumn("fp", F.sha2("data", 256))
        new = rows.groupBy("fp").agg(F.min("version").alias("version"), F.max("size").alias("size"))
        if number:
            new = against_index(new, s.read.schema("fp string, version int, size int").parquet(*[f"{index}/batch={i}" for i in range(number)]))
        new.write.mode("overwrite").parquet(f"{index}/batch={number}")

    def step(stream: DataFrame, state: str):
        return stream.writeStream.foreachBatch(grow).option("checkpointLocation", state).trigger(availableNow=True).start()

    replay(objects.select("file_id", "client", "version", "content"), OBJECT, step, versions)
    known = spark.read.parquet(index)
    return known.groupBy("version").agg(F.count("*").alias("new_chunks"), F.sum("size").cast("long").alias("new_bytes"))


def event_windows(events: DataFrame, ts: Column, width: str, delay: str) -> DataFrame:
    """Tumbling windows over event time with a watermark: rows and bytes of properties."""
    rows = events.withColumn("_ts", ts).withWatermark("_ts", delay)
    return rows.groupBy(F.window("_ts", width).alias("w")).agg(F.count("*").alias("n_events"), F.sum(F.octet_length("props")).cast("long").alias("prop_bytes")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_events", "prop_bytes")


def stream_event_windows(spark: SparkSession, sf_dir: str, width: str = "1 day") -> DataFrame:
    """All windows of the events table, read as a stream; the last trigger's totals stand."""
    out, state = new_path(spark, "windows"), new_path(spark, "state")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    totals = event_windows(stream, F.col("ts").cast("timestamp"), width, "1 day")
    totals.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)

"""Next-fit packing of payloads into containers, over sizes alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashes import container_name
from quern.ship import ship
from quern.tables import once

_PLACES = "client string, seq long, container_no long, at long"


def _next_fit(limit: int):
    schema = pa.schema([("client", pa.string()), ("seq", pa.int64()), ("container_no", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, no, used = None, 0, 0
        begun = False
        for b in batches:
            names = b["client"].to_pylist()
            nos, ats = [], []
            for c, size in zip(names, b["size"].to_pylist(), strict=True):
                if not begun or c != client:
                    client, no, used, begun = c, 0, 0, True
                if used and used + size > limit:
                    no, used = no + 1, 0
                nos.append(no)
                ats.append(used)
                used += size
            yield pa.record_batch([b["client"], b["seq"], pa.array(nos, pa.int64()), pa.array(ats, pa.int64())], schema=schema)

    return run


def next_fit(sizes: DataFrame, limit: int) -> DataFrame:
    """(client, seq, container_no, at) from (client, seq, size): a client's payloads in order of seq.

    A container is closed when the next payload doesn't fit; a payload beyond the limit has one of its own.
    The rule is sequential by nature: a client's sizes (not payloads) stream through one task, which holds
    one batch; clients pack side by side."""
    ship(sizes.sparkSession)
    rows = sizes.select(F.col("client").cast("string"), F.col("seq").cast("long"), F.col("size").cast("long"))
    return rows.repartition("client").sortWithinPartitions("client", "seq").mapInArrow(_next_fit(limit), _PLACES)


def addresses(stored: DataFrame, limit: int) -> DataFrame:
    """stored (client, seq, fp, size) with container_id, offset and length of each payload."""
    places = next_fit(stored.select("client", "seq", "size"), limit)
    named = places.select("seq", "container_no", container_name(F.col("client"), F.col("container_no")).alias("container_id"), F.col("at").alias("offset"))
    return stored.join(named, "seq").withColumnRenamed("size", "length")


def joined(parts: Column, field: str) -> Column:
    """The binary fields of an array of structs, one behind the other, in linear time (concat copies what it has each time)."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x[field])), ""))


def container_bodies(placed: DataFrame, payload: str = "payload") -> DataFrame:
    """(container_id, body, chunks): the payloads of a container one behind the other; a container is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", payload)))
    rows = placed.groupBy("container_id").agg(parts.alias("parts"))
    return rows.select("container_id", joined(F.col("parts"), payload).alias("body"), F.size("parts").alias("chunks"))


def fetch(addr: DataFrame, containers: DataFrame, payload: str = "payload") -> DataFrame:
    """addr with the bytes that its container holds at offset, for length.

    A container is joined once, to all its addresses, and cut inside the array that is exploded: a body beside
    each address would be copied for every chunk. A container has a bounded number of addresses."""
    places = addr.groupBy("container_id").agg(F.collect_list(F.struct(*addr.columns)).alias("places"))
    cut = lambda b, p: F.substring(b, (p["offset"] + 1).cast("int"), p["length"].cast("int"))
    pieces = once(F.col("body"), lambda b: F.transform("places", lambda p: F.struct(*[p[c].alias(c) for c in addr.columns], cut(b, p).alias(payload))))
    return places.join(containers.select("container_id", "body"), "container_id").select(F.inline(pieces))

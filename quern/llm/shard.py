"""Jump consistent hashing: stable keys to shards without a ring table, in Catalyst expressions only.

jump_hash() walks the published sequence b, j = floor((b + 1) * 2^31 / (top 31 bits of an LCG + 1)); the
64-bit LCG is carried as three limbs (22, 22, 20 bits), so that no product leaves a signed long. Going from
n to n + 1 shards moves a key only into shard n, and does so for 1 / (n + 1) of the keys.

Slots number the rows of a shard from 0 without gaps. Rows are dealt to (shard, lane) groups, sorted only
within them, and shifted by the counts of the lanes before: shards * lanes counts is all that is broadcast.

Cases: a null key hashes like 0; a null text has size 1 and the CRC of the empty string; repeated rows each
get a slot; no rows give no rows; shards must be 1 or more. Extra columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the published generator (its increment is 1).
MULTIPLIER = 2862933555777941757
_LOW = (1 << 22) - 1
_M = (MULTIPLIER & _LOW, (MULTIPLIER >> 22) & _LOW, MULTIPLIER >> 44)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards - 1) of a long key.

    Steps number about ln(shards); the loop is unrolled over shards steps, or 16 * (ln(shards) + 4) if that
    is less, which a walk exceeds with a probability below 1e-80."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    steps = min(shards, int(16 * (math.log(shards) + 4)))
    long = lambda x: F.lit(x).cast("long")
    k = F.coalesce(key.cast("long"), long(0))
    start = F.struct(
        long(-1).alias("b"), long(0).alias("j"),
        k.bitwiseAND(long(_LOW)).alias("k0"), F.shiftrightunsigned(k, 22).bitwiseAND(long(_LOW)).alias("k1"), F.shiftrightunsigned(k, 44).alias("k2"),
    )

    def limbs(s: Column) -> Column:
        p0 = s["k0"] * long(_M[0]) + 1
        p1 = s["k0"] * long(_M[1]) + s["k1"] * long(_M[0]) + F.shiftright(p0, 22)
        p2 = s["k0"] * long(_M[2]) + s["k1"] * long(_M[1]) + s["k2"] * long(_M[0]) + F.shiftright(p1, 22)
        return F.struct(s["j"].alias("b"), p0.bitwiseAND(long(_LOW)).alias("k0"), p1.bitwiseAND(long(_LOW)).alias("k1"), p2.bitwiseAND(long((1 << 20) - 1)).alias("k2"))

    def jump(s: Column) -> Column:
        top = F.shiftleft(s["k2"], 11).bitwiseOR(F.shiftright(s["k1"], 11)) + 1
        to = F.floor((s["b"] + 1) * (F.lit(float(1 << 31)) / top.cast("double"))).cast("long")
        return F.struct(s["b"].alias("b"), to.alias("j"), s["k0"].alias("k0"), s["k1"].alias("k1"), s["k2"].alias("k2"))

    def step(s: Column, _: Column) -> Column:
        # a one-element transform binds the new limbs once
        return F.when(s["j"] >= shards, s).otherwise(F.element_at(F.transform(F.array(limbs(s)), jump), 1))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["b"].cast("int"))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def lane_of(key: Column, crc: Column, lanes: int) -> Column:
    mark = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), crc.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(mark), 1, 6), 16, 10).cast("int"), F.lit(lanes))


def assign(rows: DataFrame, shards: int, lanes: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; slots go by lane, key, CRC and size."""
    k, t = F.col(key).cast("long"), F.col(text).cast("string")
    made = rows.select(k.alias(key), (text_bytes(t) + 1).alias("size"), text_crc32(t).alias("text_crc32"))
    made = made.withColumns({"shard": jump_hash(F.col(key), shards), "grown_shard": jump_hash(F.col(key), shards + 1), "_lane": lane_of(F.col(key), F.col("text_crc32"), lanes)})
    counts = made.groupBy("shard", "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("shard", "_lane").orderBy(key, "text_crc32", "size"))
    placed = made.withColumn("_at", within).join(F.broadcast(starts), ["shard", "_lane"])
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard")


def with_shard(rows: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """rows and their shard; a column of that name is replaced. Row by row: no shuffle."""
    return rows.withColumn(name, jump_hash(F.col(key), shards))

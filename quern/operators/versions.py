"""Version-window indexes: which features a client still holds, and how often its cached bases are referred to.

A feature stays for as long as every version touches it: at the end of version v those last touched before
v - keep + 1 go (keep = 1: only what version v touched stays)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.similarity import assign_bases
from quern.tables import release, settle, settle_only


def live_features(touches: DataFrame, current: int, keep: int = 1) -> DataFrame:
    """(client, feature, version) of the index after version `current`, from every (client, version, feature) touched."""
    last = touches.where(F.col("version") <= current).groupBy("client", "feature").agg(F.max("version").alias("version"))
    return last.where(F.lit(current) - F.col("version") < keep)


def evicted(touches: DataFrame, current: int, keep: int = 1) -> DataFrame:
    """(client, feature, version) that leave the index at the end of version `current`."""
    last = touches.where(F.col("version") <= current).groupBy("client", "feature").agg(F.max("version").alias("version"))
    return last.where(F.lit(current) - F.col("version") >= keep)


def reference_counts(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """(client, base_fp, refs, size) from (client, feature, base_fp): bases without a live feature are gone."""
    per = index.groupBy("client", "base_fp").agg(F.count("*").alias("refs"))
    return per.join(sizes.select("base_fp", "size"), "base_fp").select("client", "base_fp", "refs", "size")


INDEX = "feature long, base long, last int"


def window_similarity(chunks: DataFrame, keep: int = 1, rounds: int = 8, group_rows: int = 100_000, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(seq, base), and the index after the last version: what a client's window makes of its chunks, version by version.

    chunks: (seq, client, version, features), seq in order of version. A chunk is similar if the index of its
    client holds a feature of it; else its features are entered with it as their base. The base of a similar
    chunk follows from a vote among the owners that came before. Versions are a loop; a version's chunks are
    handled at once. `index` (INDEX) is what an earlier call gave, so that a later session goes on from there."""
    spark = chunks.sparkSession
    tagged = F.transform("features", lambda f: F.xxhash64("client", f))
    rows = settle(chunks.select("seq", "client", "version", tagged.alias("features")), "window")
    index = spark.createDataFrame([], INDEX) if index is None else index
    out = own = None
    for v in [r[0] for r in rows.select("version").distinct().orderBy("version").collect()]:
        now = rows.where(F.col("version") == v)
        each = now.select("seq", F.explode("features").alias("feature"))
        held = settle(each.join(index.select("feature"), "feature", "left_semi").select("seq").distinct(), "held")
        fresh = now.join(held, "seq", "left_anti").select("seq", "features")
        made = settle_only(lambda fresh=fresh: assign_bases(fresh, rounds, group_rows), "made")
        new = fresh.join(made.where("base is null").select("seq"), "seq").select(F.explode(F.array_distinct("features")).alias("feature"), F.col("seq").alias("base"))
        owners = settle(index.select("feature", "base").unionByName(new), "owners")
        voters = held.unionByName(made.where("base is not null").select("seq"))
        ballots = now.join(voters, "seq").select("seq", F.posexplode("features").alias("pos", "feature")).join(owners, "feature").where("base < seq")
        per = ballots.groupBy("seq", "base").agg(F.count("*").alias("votes"), F.min("pos").alias("pos"))
        won = per.groupBy("seq").agg(F.max(F.struct("votes", (-F.col("pos")).alias("pos"), "base")).alias("best")).select("seq", F.col("best.base").alias("base"))
        done = settle(now.select("seq").join(won, "seq", "left"), "similar")
        out = done if out is None else out.unionByName(done)
        touched = each.select("feature").distinct().withColumn("_now", F.lit(True))
        aged = owners.join(index.select("feature", "last"), "feature", "left").join(touched, "feature", "left")
        aged = aged.select("feature", "base", F.when(F.col("_now"), F.lit(v)).otherwise(F.col("last")).cast("int").alias("last"))
        index = settle(aged.where(F.lit(v) - F.col("last") < keep), "index")
        release(held, made, owners, *([own] if own is not None else []))  # not the index of an earlier call
        own = index
    return out if out is not None else spark.createDataFrame([], "seq long, base long"), index

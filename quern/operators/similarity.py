"""Base-chunk search over super-features: votes, pre-checks, and the greedy choice of bases.

The sequential rule walks chunks in order: a chunk of which no feature has an owner becomes a base and owns
its features; any other is similar and votes among the owners of its features (most features; if all have
one, the owner of the first feature that has any). A feature has one owner for ever, so the bases are the
lexicographically first maximal independent set of the graph of shared features, which rounds of group-by
and join find without a walk; what is left after a few rounds is walked by component.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.ship import ship
from quern.tables import components, release, settle


def vote(chunks: DataFrame, owners: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(key, base, votes) of the chunks that share a feature with owners (feature, base).

    Repeated features of a chunk count each; equal counts of two or more go to the smaller first position."""
    rows = chunks.select(key, F.posexplode(features).alias("pos", "feature"))
    met = rows.join(owners.select("feature", "base"), "feature")
    per = met.groupBy(key, "base").agg(F.count("*").alias("votes"), F.min("pos").alias("pos"))
    best = F.max(F.struct("votes", (-F.col("pos")).alias("pos"), "base"))
    return per.groupBy(key).agg(best.alias("best")).select(key, F.col("best.base").alias("base"), F.col("best.votes").alias("votes"))


def precheck(chunks: DataFrame, index: DataFrame, key: str, features: str = "features") -> DataFrame:
    """The keys of chunks that share any feature with an index (feature): a semi join on exploded features."""
    return chunks.select(key, F.explode(features).alias("feature")).join(index.select("feature"), "feature", "left_semi").select(key).distinct()


def _walk(rows: list[tuple]) -> list[tuple]:
    """The sequential rule over (seq, features): (seq, is_base)."""
    owned: set = set()
    out = []
    for seq, features in sorted(rows):
        base = owned.isdisjoint(features)
        if base:
            owned.update(features)
        out.append((seq, base))
    return out


def greedy_bases(chunks: DataFrame, rounds: int = 8, group_rows: int = 100_000, key: str = "seq", features: str = "features") -> DataFrame:
    """(key, is_base) of every chunk; key is a long that gives the order, one row a key.

    A round makes bases of the undecided chunks that come first at every feature of theirs, and similar
    ones of those that share a feature with a base. Each round decides the first chunk left at least.
    As soon as at most group_rows chunks are left, one task walks them: none shares a feature with a base so far."""
    spark = chunks.sparkSession
    ship(spark)
    left = settle(chunks.select(F.col(key).cast("long").alias("seq"), F.array_distinct(features).alias("features")), "undecided")
    decided = []
    turn = 0
    while many := left.count():
        if many <= group_rows:
            decided.append(settle(left.withColumn("root", F.lit(0)).groupBy("root").applyInPandas(_walk_rows, "seq long, is_base boolean"), "walked"))
            break
        if turn and turn % rounds == 0:
            local = _by_component(left, group_rows)
            if local is not None:
                done = settle(local, "walked")
                decided.append(done)
                was, left = left, settle(left.join(done.select("seq"), "seq", "left_anti"), "undecided")
                release(was)
                turn += 1
                continue
        turn += 1
        each = left.select("seq", F.explode("features").alias("feature"))
        first = each.groupBy("feature").agg(F.min("seq").alias("owner"))
        lone = left.where(F.size("features") == 0).select("seq")
        mine = first.groupBy(F.col("owner").alias("seq")).agg(F.count("*").alias("n"))
        bases = settle(left.join(mine, "seq").where(F.size("features") == F.col("n")).select("seq", "features"), "bases")
        taken = bases.select(F.explode("features").alias("feature")).distinct()
        similar = each.join(taken, "feature", "left_semi").select("seq").distinct().join(bases, "seq", "left_anti")
        now = bases.select("seq", F.lit(True).alias("is_base")).unionByName(lone.withColumn("is_base", F.lit(True))).unionByName(similar.withColumn("is_base", F.lit(False)))
        now = settle(now, "decided")
        decided.append(now)
        was, left = left, settle(left.join(now.select("seq"), "seq", "left_anti"), "undecided")
        release(was, bases)
    if not decided:
        return spark.createDataFrame([], "seq long, is_base boolean")
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def _by_component(left: DataFrame, group_rows: int) -> DataFrame | None:
    """Undecided chunks in components of at most group_rows, walked; larger components stay undecided."""
    each = left.select("seq", F.explode("features").alias("feature"))
    first = settle(each.groupBy("feature").agg(F.min("seq").alias("a"), F.count("*").alias("n")).where("n > 1"), "first")
    roots = components(each.join(first, "feature").select("a", F.col("seq").alias("b")), "greedy")
    if roots is None:
        return None
    of = left.join(roots.select(F.col("node").alias("seq"), "root"), "seq", "left").withColumn("root", F.coalesce("root", "seq"))
    small = of.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= group_rows).select("root")
    return of.join(small, "root", "left_semi").groupBy("root").applyInPandas(_walk_rows, "seq long, is_base boolean")


def _walk_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    done = _walk([(s, tuple(f)) for s, f in zip(pdf["seq"], pdf["features"], strict=True)])
    return pd.DataFrame(done, columns=["seq", "is_base"])


def assign_bases(chunks: DataFrame, rounds: int = 8, group_rows: int = 100_000, key: str = "seq", features: str = "features") -> DataFrame:
    """(key, base): the base's key for similar chunks, null for bases."""
    found = settle(greedy_bases(chunks, rounds, group_rows, key, features), "greedy")
    rows = chunks.select(F.col(key).cast("long").alias("seq"), F.col(features).alias("features"))
    owners = rows.join(found.where("is_base").select("seq"), "seq").select(F.explode(F.array_distinct("features")).alias("feature"), F.col("seq").alias("base"))
    owners = settle(owners, "owners")
    # an owner that comes later can't have been there when the chunk was seen
    similar = rows.join(found.where("not is_base").select("seq"), "seq")
    met = similar.select("seq", F.posexplode("features").alias("pos", "feature")).join(owners, "feature").where("base < seq")
    per = met.groupBy("seq", "base").agg(F.count("*").alias("votes"), F.min("pos").alias("pos"))
    best = per.groupBy("seq").agg(F.max(F.struct("votes", (-F.col("pos")).alias("pos"), "base")).alias("best")).select("seq", F.col("best.base").alias("base"))
    return found.join(best, "seq", "left").select("seq", "base")

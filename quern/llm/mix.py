"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: the sources, by code point and null last, weigh 5, 2, 1 and so on; they share the words of all
documents by weight, none beyond `most` times its own words, what is above being shared again by weight
(the level of that water-filling is found in closed form).

Copies: a document is certain of floor(target / words of its source) whole copies; what is left of the target
is sampled. A document's inclusion probability is p = c * m, 1 at most, with m its words (times `favour`, a
positive column such as a quality score, where one is given) and c such that the expected words are those left;
documents of p = 1 are certain. Of each size class (a sixteenth of a doubling of m) a fixed number is
taken: the documents of the least Q, their random odds u / (1 - u) over their inclusion odds p / (1 - p), with u
a hash of id and size. The numbers come by classes, the largest first: c is what is left of the words over the
sum of m * words of this class and those below; the sum of the class's p is rounded up or down at random, so
that it is right on average; and what was taken leaves the words for the classes below, whose documents are
smaller and even out what the larger ones rounded. A class takes no more than fits the words left, and
not so few that the classes below can't hold the rest, each to the nearest document.

Ranks are never sorted as a whole: Q / (1 + Q) is cut into buckets, whose counts locate the bucket in which a
class's number is reached, and only that bucket is sorted. The classes of a source are some hundreds, whatever
its rows; a hot source is summed before its shuffle and joined by salts.

Cases: null and blank texts have size 0 and are taken 0 words; a source without words has target 0; null
ids and repeated rows count as rows of their own; no rows give no rows; extra columns are ignored. Reruns
agree, as ranks depend on values alone (rows equal in id, size and text are interchangeable).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, salted_join, settle

#: Fixed value: words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: str = "mix"
    buckets: int = 512
    steps: int = 16  # size classes a doubling


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(seed: str, key: Column, size: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5 of key and size (or class)."""
    mark = F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), size.cast("string"))
    return (F.conv(F.substring(F.md5(mark), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row for each source, sorted in one task."""
    n = len(p.weights)
    spot = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (F.pmod(spot - 1, F.lit(n)) + 1).cast("int"))
    one = sizes.withColumns({"spot": spot, "w": weight}).withColumn("cap", F.col("source_size") * float(p.most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "spot")
    every = Window.partitionBy()
    over = one.withColumns(
        {
            "below": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(every).cast("double"),
        }
    ).withColumn("level", (F.col("all") - F.col("below")) / F.col("rest"))
    top = F.max(F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level"))).over(every)
    return over.withColumn("top", top).select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("top"), F.col("cap"))).alias("target"))


def size_class(measure: Column, steps: int) -> Column:
    """A number that grows with a positive measure, `steps` to each doubling, by integers alone; 0 for 0."""
    bits = F.length(F.bin(measure))
    return F.when(measure > 0, bits * steps + F.call_function("shiftright", measure * steps, bits - 1) - steps).otherwise(0).cast("int")


def numbers(classes: DataFrame, shares: DataFrame, p: MixParams) -> DataFrame:
    """(src, cls, whole, target, source_size, n, c, take): how many of each class are taken beside whole copies, and c = p / m."""
    below = Window.partitionBy("src").orderBy("cls").rowsBetween(Window.unboundedPreceding, 0)
    one = classes.select("src", "cls", "n", F.col("m").cast("double").alias("m"), F.col("mw").cast("double").alias("mw"), F.sum("mw").over(below).cast("double").alias("b"), (F.sum("words").over(below) - F.col("words")).cast("double").alias("w"), uniform(p.seed, F.col("src"), F.col("cls")).alias("u"))
    per = one.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("cls", "n", "m", "mw", "b", "w", "u")), asc=False).alias("classes")).join(shares, "src")
    none = F.array().cast("array<struct<cls:int,n:bigint,c:double,take:bigint>>")

    def step(s: Column, x: Column) -> Column:
        c = F.when((x["b"] > 0) & (s["r"] > 0), s["r"] / x["b"]).otherwise(0.0)
        mean = x["mw"] / x["m"]
        drawn = F.floor(F.least(x["n"].cast("double"), c * x["m"]) + x["u"])
        enough = F.floor((s["r"] - x["w"]) / mean + 0.5)  # fewer would leave more than the classes below hold
        least = F.least(x["n"].cast("double"), F.greatest(F.least(drawn, F.floor(s["r"] / mean)), enough)).cast("long")
        take = F.when(c > 0, least).otherwise(F.lit(0).cast("long"))
        left = F.when(take > 0, s["r"] - take * mean).otherwise(s["r"])
        return F.struct(left.alias("r"), F.concat(s["out"], F.array(F.struct(x["cls"].alias("cls"), x["n"].alias("n"), c.alias("c"), take.alias("take")))).alias("out"))

    walked = F.aggregate("classes", F.struct(F.col("left").alias("r"), none.alias("out")), step, lambda s: s["out"])
    return per.select("src", "whole", "target", "source_size", F.inline(walked))


def mix(docs: DataFrame, p: MixParams = MixParams(), key: str = "doc_id", text: str = "text", source: str = "source", favour: str | None = None) -> DataFrame:
    """(rk, key, size, source_size, target, taken, copies) of every row; rk is the hash of id, text and source."""
    k, t, s = F.col(key).cast("long"), F.col(text).cast("string"), F.col(source).cast("string")
    good = F.greatest(F.lit(1), F.round(F.col("size") * F.col(favour).cast("double"))) if favour else F.col("size")
    rows = docs.withColumn("size", words(t)).select(k.alias("id"), s.alias("source"), "size", F.xxhash64(k, t, s).alias("rk"), F.when(F.col("size") > 0, good).otherwise(0).cast("long").alias("m"))
    # src: the source as a key that is never null
    src = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "u": uniform(p.seed, F.col("id"), F.col("size")), "src": src, "cls": size_class(F.col("m"), p.steps)})
    rows = settle(rows, "mix")
    product = F.col("m").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")
    classes = rows.groupBy("src", "cls").agg(F.any_value("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words"), F.sum("m").alias("m"), F.sum(product).alias("mw"))
    classes = settle(classes, "classes")
    shares = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), p).withColumn("src", src)
    fold = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    shares = shares.drop("source").withColumn("whole", fold).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = settle(numbers(classes, shares, p), "numbers")

    def ranked(plan: DataFrame) -> DataFrame:
        joined = salted_join(rows.drop("source"), plan, ["src", "cls"], F.col("row"), "inner")
        chance = F.col("c") * F.col("m")
        odds = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
        # certain documents come before all others, at random among themselves
        q = F.when(F.col("take") > 0, F.when(chance >= 1, F.col("u") - 1).otherwise(odds))
        return joined.withColumn("q", q).withColumn("bucket", F.floor(F.when(F.col("q") < 0, F.col("q")).otherwise(F.col("q") / (1 + F.col("q"))) * p.buckets).cast("int"))

    # the bucket in which each class's number is reached, and how many of it are taken
    counts = ranked(plan).where("q is not null").groupBy("src", "cls", "take", "bucket").agg(F.count("*").alias("rows"))
    run = Window.partitionBy("src", "cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("upto", F.sum("rows").over(run)).where(F.col("upto") >= F.col("take"))
    first = F.min(F.struct("bucket", (F.col("take") - F.col("upto") + F.col("rows")).alias("need"))).alias("at")
    cut = settle(reached.groupBy("src", "cls").agg(first).select("src", "cls", F.col("at.bucket").alias("cut"), "at.need"), "cut")
    plan = settle(plan.join(cut, ["src", "cls"], "left"), "plan")
    place = F.struct("q", F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "rk", "row")
    edge = ranked(plan).where("bucket = cut").withColumn("place", place)
    nth = edge.withColumn("i", F.row_number().over(Window.partitionBy("src", "cls").orderBy("place"))).where("i = need")
    plan = settle(plan.join(nth.select("src", "cls", F.col("place").alias("last")), ["src", "cls"], "left"), "plan")
    more = F.col("q").isNotNull() & ((F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (place <= F.col("last"))))
    got = ranked(plan).withColumn("copies", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long"))
    return got.select("rk", F.col("id").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, p: MixParams = MixParams(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as the mix takes them: every row as often as its copies, with docs' columns."""
    rk, copies, rows, row, one = (fresh(n, docs.columns) for n in ("_rk", "_copies", "_rows", "_row", "_one"))
    took = mix(docs, p, key, text, source).groupBy(F.col("rk").alias(rk)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    mark = F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"), F.col(source).cast("string"))
    found = docs.withColumn(rk, mark).join(took.where(F.col(copies) > 0).hint("shuffle_hash"), rk)
    cols = [F.col(c) for c in docs.columns]
    again = found.where(F.col(rows) > 1).groupBy(rk, copies).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias(row)).select(f"{row}.*", copies)
    whole = found.where(F.col(rows) == 1).select(*docs.columns, copies).unionByName(again)
    return whole.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)

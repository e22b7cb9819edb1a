"""Multi-party perspective rotation of dialogues, in DataFrame operations.

For every participant of a conversation (every speaker but the system) the dialogue is rendered once with
that speaker as the assistant, all others as named users, and the mask covers what that speaker says, with
the end marker that closes it. Marks inside texts are broken up so that no text can fake a turn.

A participant is a role as it stands, but for spaces around it; the name shown has underscores for characters
that a header can't hold. Where two roles of a conversation would be shown alike, the first by code point keeps
the name and the others get "#2", "#3" and so on, which no other name can hold.

A conversation of any length is rendered in parts: turns go to chunks of `turns` turn numbers, and a chunk of
more rows than that (repeated numbers, null ones) into pieces, so that no task gathers more than that many
turns. Part and piece are 0 for ordinary conversations; the rows of a conversation in order of part and piece
are the whole dialogue.

Cases: a null conversation id is a conversation of its own; null turns come last, in a part of their own
(part null); turns that repeat are all kept, by role and text; null texts are empty; a null or blank role is
one participant, shown as "unknown"; conversations of the system alone have no participant and no row; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import salted_join

#: The marks that open and close a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class ChatParams:
    system: str = "system"
    turns: int = 512


def speaker_name(role: Column) -> Column:
    """A name fit for a header: white space, angle brackets, bars and number signs become underscores."""
    clean = F.regexp_replace(role, r"[\s<>|#]", "_")
    return F.when(clean == "", F.lit("unknown")).otherwise(clean)


def rotate(turns: DataFrame, p: ChatParams = ChatParams(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, piece, perspective, n_turns, text, mask): mask lists start:end, code points, end exclusive."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.trim(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
        F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    ).withColumn("part", F.floor(F.col("turn") / p.turns).cast("long"))
    people = rows.select("conv", "role").distinct().withColumn("clean", speaker_name(F.col("role")))
    alike = F.row_number().over(Window.partitionBy("conv", "clean").orderBy("role"))
    people = people.withColumn("nth", alike).withColumn("name", F.when(F.col("nth") == 1, F.col("clean")).otherwise(F.concat_ws("#", "clean", F.col("nth").cast("string"))))
    # names that differ from the cleaned role are few or none; the key is never null
    mark = F.when(F.col("conv").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("conv").cast("string")))
    other = people.where("nth > 1").select(mark.alias("_mark"), "role", "name")
    named = salted_join(rows.withColumn("_mark", mark), other, ["_mark", "role"], F.col("said"))
    rows = named.select("conv", "turn", "part", F.coalesce("name", speaker_name(F.col("role"))).alias("speaker"), "said")
    people = people.where(F.col("name") != p.system).select(F.col("conv").alias("_conv"), F.col("name").alias("perspective"))
    order = Window.partitionBy("conv", "part").orderBy("turn", "speaker", "said")
    cut = rows.withColumn("at", F.row_number().over(order)).withColumn("piece", F.floor((F.col("at") - 1) / p.turns).cast("long"))
    parts = cut.groupBy("conv", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "speaker", "said"))).alias("turns"))
    both = parts.join(people, F.col("conv").eqNullSafe(F.col("_conv")))
    mine = F.col("perspective")

    def head(t: Column) -> Column:
        who = F.when(t["speaker"] == p.system, F.lit("system")).when(t["speaker"] == mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.concat(F.lit(OPEN), who, F.lit("\n"))

    shown = both.withColumn("segs", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["said"], F.lit(CLOSE)).alias("body"), (t["speaker"] == mine).alias("own"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def walk(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.concat(F.when(s["spans"] == "", F.lit("")).otherwise(F.lit(",")), a.cast("string"), F.lit(":"), b.cast("string"))
        return F.struct((b + 1).alias("at"), F.concat(s["spans"], F.when(x["own"], span).otherwise(F.lit(""))).alias("spans"))

    return shown.select(
        F.col("conv").alias(conv), "part", "piece", "perspective", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("segs", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("segs", start, walk, lambda s: s["spans"]).alias("mask"),
    )

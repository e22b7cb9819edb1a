"""Exact deduplication by fingerprint. Payloads never take part in a shuffle here; rows may carry them elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("version", "file_id", "chunk_no")


def first_occurrence(chunks: DataFrame, fp: str = "fp", order: tuple[str, ...] = ORDER) -> DataFrame:
    """(fp, seq, copies): each fingerprint's first place in the order and how often it occurs."""
    return chunks.groupBy(fp).agg(F.min(F.struct(*order)).alias("seq"), F.count("*").alias("copies"))


def label(chunks: DataFrame, fp: str = "fp", order: tuple[str, ...] = ORDER) -> DataFrame:
    """chunks with status unique (its fingerprint's first place) or duplicate.

    Joins on a place, which is unique, not on the fingerprint, of which one may make up most of the rows."""
    firsts = first_occurrence(chunks, fp, order).select("seq.*", F.lit(True).alias("_first"))
    found = chunks.join(firsts, list(order), "left")
    return found.withColumn("status", F.when(F.col("_first"), "unique").otherwise("duplicate")).drop("_first")


def against_index(chunks: DataFrame, index: DataFrame, fp: str = "fp") -> DataFrame:
    """chunks whose fingerprint an index of former runs doesn't hold."""
    return chunks.join(index.select(fp), fp, "left_anti")


def stats(chunks: DataFrame, by: tuple[str, ...] = (), fp: str = "fp", size: str = "size") -> DataFrame:
    """Logical and unique chunks and bytes; with `by`, of each group on its own."""
    per = chunks.groupBy(*by, fp).agg(F.count("*").alias("n"), F.max(size).alias("one"))
    return per.groupBy(*by).agg(
        F.sum("n").cast("long").alias("logical_chunks"), F.sum(F.col("n") * F.col("one")).cast("long").alias("logical_bytes"),
        F.count("*").alias("unique_chunks"), F.sum("one").cast("long").alias("unique_bytes"),
    )

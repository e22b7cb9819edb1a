"""Chunk keys: none, message-locked, and similarity-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import ReductionConfig
from quern.operators.similarity import assign_bases


def plain_key() -> Column:
    return F.lit(bytes(32))


def message_locked(fp_hex: Column, secret: bytes) -> Column:
    """SHA-256 of the secret and the chunk's fingerprint."""
    return F.unhex(F.sha2(F.concat(F.lit(secret), F.unhex(fp_hex)), 256))


def chunk_key(data: Column, seed: Column) -> Column:
    """SHA-256 of the first 32 bytes of the chunk (zeros where it is shorter) and the seed."""
    head = F.substring(F.concat(F.substring(data, 1, 32), F.lit(bytes(32))), 1, 32)
    return F.unhex(F.sha2(F.concat(head, seed), 256))


def perturbed(key: Column, seed: Column) -> Column:
    """The key with its last four bytes replaced by the seed (low 32 bits, little-endian)."""
    h = F.lpad(F.hex(seed.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")
    at = lambda i: F.substring(h, i, 2)
    return F.concat(F.substring(key, 1, 28), F.unhex(F.concat(at(7), at(5), at(3), at(1))))


def feature_bytes(features: Column) -> Column:
    """The features as little-endian 64-bit words, one after the other."""
    one = lambda v: F.reverse(F.regexp_extract_all(F.lpad(F.hex(v), 16, "0"), F.lit("(..)"), F.lit(1)))
    return F.unhex(F.array_join(F.flatten(F.transform(features, one)), ""))


def similarity_seeds(chunks: DataFrame, cfg: ReductionConfig, key: str = "seq", features: str = "features") -> DataFrame:
    """(key, seed, base): similar chunks have their base's seed, a base's seed is SHA-256 of secret and features."""
    found = assign_bases(chunks, cfg.greedy_rounds, cfg.group_rows, key, features)
    own = chunks.select(F.col(key).alias("base_seq"), F.unhex(F.sha2(F.concat(F.lit(cfg.secret), feature_bytes(F.col(features))), 256)).alias("seed"))
    return found.withColumn("base_seq", F.coalesce("base", "seq")).join(own, "base_seq").select(F.col("seq").alias(key), "seed", "base")

"""Deterministic encryption of chunks. The counter starts at 0 for every key, so that equal chunks stay equal.

Counter mode is the XOR of the data with the encrypted counters; the built-in AES gives the key stream
(electronic code book over a constant), and only the XOR is a kernel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.codecs import xor


def counter_blocks(most: int) -> bytes:
    return b"".join(i.to_bytes(16, "big") for i in range(-(-most // 16)))


def key_stream(size: Column, key: Column, most: int) -> Column:
    """At least `size` bytes of AES-256 counter-mode key stream, for data of at most `most` bytes."""
    blocks = F.substring(F.lit(counter_blocks(most)), F.lit(1), (F.ceil(size / 16) * 16).cast("int"))
    return F.aes_encrypt(blocks, key, F.lit("ECB"), F.lit("PKCS"))


def counter_mode(data: Column, key: Column, most: int) -> Column:
    """Length-preserving; its own inverse."""
    return xor(data, key_stream(F.octet_length(data), key, most))


def two_phase(data: Column, key: Column, most: int) -> Column:
    """Counter mode, then the code book with padding, under one key."""
    return F.aes_encrypt(counter_mode(data, key, most), key, F.lit("ECB"), F.lit("PKCS"))


def two_phase_inverse(cipher: Column, key: Column, most: int) -> Column:
    return counter_mode(F.try_aes_decrypt(cipher, key, F.lit("ECB"), F.lit("PKCS")), key, most)


def block_mode(data: Column, key: Column, mode: str) -> Column:
    """ECB, CBC (zero vector) or GCM (zero vector) by the built-in AES."""
    if mode == "ECB":
        return F.aes_encrypt(data, key, F.lit("ECB"), F.lit("PKCS"))
    if mode == "CBC":
        return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), F.lit(bytes(16)))
    if mode == "GCM":
        return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("NONE"), F.lit(bytes(12)))
    raise ValueError(f"no mode {mode!r}")


def block_mode_inverse(cipher: Column, key: Column, mode: str) -> Column:
    return F.try_aes_decrypt(cipher, key, F.lit(mode), F.lit("NONE" if mode == "GCM" else "PKCS"))

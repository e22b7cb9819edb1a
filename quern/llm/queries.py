"""Queries of the ten operators and the pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item found in a document: its matches, and place and distance of the nearest (the first of equals)."""
    from quern.llm.decontam import find_leaks

    hits = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    best = F.min(F.struct("distance", "start", "end"))
    found = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_matches"), best.alias("best"))
    return found.select("doc_id", "item_id", "n_matches", F.col("best.distance").alias("distance"), F.col("best.start").alias("match_start"), F.col("best.end").alias("match_end"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.secrets import digest, find, labelled_samples, train, words_of

    docs = _read(spark, sf_dir, "documents")
    return digest(find(docs, train(labelled_samples(spark).unionByName(words_of(docs)))))


def op3_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.chat import rotate

    return rotate(_read(spark, sf_dir, "conversations"))


def op4_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.shard import assign

    return assign(_read(spark, sf_dir, "documents"), 16)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.minhash import NearDupParams, near_duplicates

    found = near_duplicates(_read(spark, sf_dir, "documents"), NearDupParams(words=3, percent=85))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_spann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ann import search

    return search(_read(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), 20)


def op7_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mix import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import fit, score

    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.warc import archive, read

    return read(archive(_read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quern.llm.tokens import TokenParams, read, write

    return read(write(_read(spark, sf_dir, "documents"), TokenParams(public_tokenizers.path("word_bpe_49k.json"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontam": op1_decontam,
    "op2_secrets": op2_secrets,
    "op3_rotation": op3_rotation,
    "op4_jump": op4_jump,
    "op5_minhash": op5_minhash,
    "op6_spann": op6_spann,
    "op7_pareto": op7_pareto,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_tokens": op10_tokens,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_rotation": r"""
WITH raw AS (
  SELECT conv_id, turn, trim(coalesce(role, ''), ' ') AS role, replace(coalesce(text, ''), '<|', '< |') AS said, CAST(floor(turn / 512.0) AS BIGINT) AS part
  FROM conversations),
known AS (SELECT DISTINCT conv_id, role, CASE WHEN role = '' THEN 'unknown' ELSE regexp_replace(role, '[\s<>|#]', '_', 'g') END AS clean FROM raw),
named AS (SELECT *, row_number() OVER (PARTITION BY conv_id, clean ORDER BY role) AS nth FROM known),
t AS (SELECT r.conv_id, r.turn, r.said, r.part, CASE WHEN nth = 1 THEN clean ELSE clean || '#' || nth END AS speaker
      FROM raw r JOIN named n ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.role = n.role),
cut AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, speaker, said) AS pos FROM t),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
seg AS (
  SELECT c.conv_id, c.part, (c.pos - 1) // 512 AS piece, p.perspective, c.pos, c.speaker = p.perspective AS own,
         '<|im_start|>' || CASE WHEN c.speaker = 'system' THEN 'system' WHEN c.speaker = p.perspective THEN 'assistant' ELSE 'user name=' || c.speaker END || chr(10) AS head,
         c.said || '<|im_end|>' AS body
  FROM cut c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, piece, perspective ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seg)
SELECT conv_id, part, CAST(piece AS BIGINT) AS piece, perspective, CAST(count(*) AS BIGINT) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(CAST(before + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(before + length(head) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, part, piece, perspective
""",
    "op4_jump": r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) r(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT r, doc_id, n + 1 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS text_crc32 FROM d, tab),
w AS (
  SELECT r, s, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, CASE WHEN coalesce(doc_id, 0) < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(coalesce(doc_id, 0) AS HUGEINT) END AS k FROM e, (VALUES (16), (17)) v(s)
  UNION ALL
  SELECT r, s, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1 AS DOUBLE))) AS BIGINT), (k * 2862933555777941757 + 1) % 18446744073709551616
  FROM w WHERE j < s),
g AS (SELECT r, CAST(max(b) FILTER (WHERE s = 16) AS INT) AS shard, CAST(max(b) FILTER (WHERE s = 17) AS INT) AS grown_shard FROM w WHERE j >= s GROUP BY r),
l AS (SELECT e.*, g.shard, g.grown_shard, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)), 1, 6) AS INT) % 256 AS lane FROM e JOIN g USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY lane, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM l
""",
    "op9_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)
""",
    "op7_pareto": r"""
WITH RECURSIVE raw AS (
  SELECT doc_id AS id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
rnd AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN length(bin(size)) * 16 + ((size * 16) >> (length(bin(size)) - 1)) - 16 ELSE 0 END AS INT) AS cls,
         (CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM raw),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rnd GROUP BY source),
spot AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS spot FROM src),
wt AS (SELECT *, CASE (spot - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM spot),
lev AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, spot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
tgt AS (SELECT *, least(cap, coalesce(w * max(CASE WHEN cap / w > level THEN level END) OVER (), cap)) AS target FROM lev),
sh AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM tgt),
shares AS (SELECT *, target - whole * source_size AS rem FROM sh),
cl AS (SELECT source, cls, count(*) AS n, sum(size) AS words, CAST(sum(size) AS DOUBLE) AS m, sum(size * size) AS mw FROM rnd GROUP BY source, cls),
walk AS (
  SELECT source, cls, n, m, CAST(mw AS DOUBLE) AS mw, CAST(sum(words) OVER (PARTITION BY source ORDER BY cls) - words AS DOUBLE) AS w, CAST(sum(mw) OVER (PARTITION BY source ORDER BY cls) AS DOUBLE) AS b, row_number() OVER (PARTITION BY source ORDER BY cls DESC) AS k,
         (CAST(CAST('0x' || substr(md5('mix|' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END || '|' || CAST(cls AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM cl),
fold AS (
  SELECT source, CAST(0 AS BIGINT) AS k, CAST(-1 AS INT) AS cls, 0.0::DOUBLE AS c, CAST(0 AS BIGINT) AS take, rem AS r FROM shares
  UNION ALL
  SELECT source, k, cls, c, take, CASE WHEN take > 0 THEN r - take * (mw / m) ELSE r END FROM (
    SELECT *, CASE WHEN c > 0 THEN CAST(least(CAST(n AS DOUBLE), greatest(least(floor(least(CAST(n AS DOUBLE), c * m) + u), floor(r / (mw / m))), floor((r - w) / (mw / m) + 0.5::DOUBLE))) AS BIGINT) ELSE 0 END AS take FROM (
      SELECT w.*, f.r, CASE WHEN w.b > 0 AND f.r > 0 THEN f.r / w.b ELSE 0.0::DOUBLE END AS c
      FROM fold f JOIN walk w ON f.source IS NOT DISTINCT FROM w.source AND w.k = f.k + 1))),
ranked AS (
  SELECT r.*, s.source_size, s.target, s.whole, f.take,
         CASE WHEN f.take > 0 THEN CASE WHEN f.c * r.size >= 1 THEN r.u - 1 ELSE (r.u / (1 - r.u)) / ((f.c * r.size) / (1 - f.c * r.size)) END END AS q
  FROM rnd r JOIN shares s ON r.source IS NOT DISTINCT FROM s.source JOIN fold f ON r.source IS NOT DISTINCT FROM f.source AND r.cls = f.cls),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, cls ORDER BY q, id, size) AS i FROM ranked)
SELECT id AS doc_id, size, source_size, target, CAST((whole + CASE WHEN q IS NOT NULL AND i <= take THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed
""",
}

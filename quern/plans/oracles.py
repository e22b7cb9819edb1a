"""DuckDB SQL of the queries that SQL can express. Chunks are cut from hex text, two digits a byte."""

from __future__ import annotations


def _chunks(size: int) -> str:
    return f"""
obj AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, coalesce(lang, '') AS client, coalesce(TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT), 0) // 5 AS version,
               hex(encode(coalesce(text, ''))) AS h FROM documents),
ch AS (SELECT file_id, client, version, CAST(i AS BIGINT) AS chunk_no, substr(h, CAST(i * {2 * size} + 1 AS BIGINT), {2 * size}) AS hx
       FROM (SELECT *, unnest(generate_series(0, CAST((length(h) // 2 - 1) // {size} AS BIGINT))) AS i FROM obj WHERE length(h) > 0)),
c AS (SELECT *, CAST(length(hx) // 2 AS BIGINT) AS size, sha256(unhex(hx)) AS fp FROM ch)"""


C256, C1024 = _chunks(256), _chunks(1024)
_SUM = "CAST(sum(size) AS BIGINT)"
_HALF = "CAST(list_sum(list_transform(range(0, 32), lambda i: CAST('0x' || substr({0}, CAST(2 * i + 1 AS INT), 2) AS INT))) AS BIGINT)"

_SHINGLES = (
    C1024
    + """,
u AS (SELECT fp, any_value(hx) AS hx, min(version) AS version FROM c GROUP BY fp),
sub AS (SELECT fp, version, hx, s, length(hx) // 2 AS n, (length(hx) // 2) // 12 AS w FROM u, range(0, 12) t(s)),
peak AS (
  SELECT fp, version, s, coalesce(list_max(list_transform(range(0, CAST(greatest(0, (CASE WHEN s = 11 THEN n - 11 * w ELSE w END) - 3) AS BIGINT)),
         lambda j: md5(unhex(substr(hx, CAST((s * w + j) * 2 + 1 AS BIGINT), 8))))), '') AS p FROM sub),
rk AS (SELECT fp, version, s // 3 AS g, row_number() OVER (PARTITION BY fp, s // 3 ORDER BY p DESC) AS i, p FROM peak),
feat AS (SELECT fp, any_value(version) AS version, i, md5(string_agg(p, '' ORDER BY g)) AS f FROM rk GROUP BY fp, i)"""
)

_RESTORED = """SELECT coalesce(TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT), 0) // 5 AS version, CAST(doc_id AS VARCHAR) AS file_id,
       CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(encode(text)) AS sha256 FROM documents WHERE octet_length(encode(coalesce(text, ''))) > 0"""

_PACK = """
WITH RECURSIVE d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
w AS (
  SELECT rn, doc_id, size, CAST(0 AS BIGINT) AS container_no, CAST(0 AS BIGINT) AS at_byte FROM d WHERE rn = 1
  UNION ALL
  SELECT d.rn, d.doc_id, d.size, CASE WHEN w.at_byte + w.size > 0 AND w.at_byte + w.size + d.size > 65536 THEN w.container_no + 1 ELSE w.container_no END,
         CASE WHEN w.at_byte + w.size > 0 AND w.at_byte + w.size + d.size > 65536 THEN 0 ELSE w.at_byte + w.size END
  FROM w JOIN d ON d.rn = w.rn + 1)"""

_LABEL = C256 + ", l AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY version, file_id, chunk_no) = 1 AS first FROM c)"
_WHOLE = _SHINGLES + """,
t AS (SELECT c.client, feat.f AS feature, max(c.version) AS version FROM c JOIN feat USING (fp) GROUP BY ALL),
cur AS (SELECT max(version) AS now FROM c)"""


#: Distinct chunks in order of their first place, walked one by one: a chunk of which no feature is owned becomes a base.
_GREEDY = "RECURSIVE " + _SHINGLES + """,
pl AS (SELECT fp, min({'version': version, 'file_id': file_id, 'chunk_no': chunk_no}) AS place FROM c GROUP BY fp),
ft AS (SELECT fp, list(CAST('0x' || substr(f, 1, 15) AS BIGINT) ORDER BY i) AS fs FROM feat GROUP BY fp),
q AS (SELECT fp, fs, row_number() OVER (ORDER BY place) AS seq FROM pl JOIN ft USING (fp)),
wk AS (
  SELECT CAST(0 AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS owned, false AS is_base
  UNION ALL
  SELECT q.seq, CASE WHEN list_has_any(wk.owned, q.fs) THEN wk.owned ELSE list_concat(wk.owned, q.fs) END, NOT list_has_any(wk.owned, q.fs) FROM wk JOIN q ON q.seq = wk.seq + 1),
ow AS (SELECT DISTINCT unnest(q.fs) AS f, q.seq AS base FROM q JOIN wk USING (seq) WHERE wk.is_base),
bal AS (SELECT seq, unnest(fs) AS f, unnest([0, 1, 2]) AS pos FROM q JOIN wk USING (seq) WHERE NOT wk.is_base),
per AS (SELECT bal.seq, ow.base, count(*) AS votes, min(pos) AS pos FROM bal JOIN ow USING (f) WHERE ow.base < bal.seq GROUP BY ALL),
won AS (SELECT seq, base FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY votes DESC, pos, base DESC) AS rn FROM per) WHERE rn = 1),
gr AS (SELECT q.seq, q.fp, won.base, b.fp AS base_fp, coalesce(b.fs, q.fs) AS fs FROM q LEFT JOIN won USING (seq) LEFT JOIN q b ON b.seq = won.base)"""

_LE = "||".join(f"substr(printf('%016x', x), {i}, 2)" for i in range(15, 0, -2))

#: The chunker's rule byte by byte: [place, bytes in the chunk, hash, ends...]; 160 is where the loose mask begins.
_CDC = """
gear AS (SELECT list(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) // 2 ORDER BY b) AS g FROM (SELECT b, sha256('gear:0:' || b) AS h FROM range(0, 256) t(b))),
obj AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, hex(encode(text)) AS h FROM documents WHERE text <> ''),
walk AS (
  SELECT file_id, h, list_reduce(list_prepend(CAST([0, 0, 0] AS BIGINT[]), list_transform(range(0, length(h) // 2), lambda i: [CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)])),
    lambda s, x: CASE
      WHEN s[2] < 64 THEN list_concat([s[1] + 1, s[2] + 1, 0], s[4:])
      WHEN s[2] + 1 >= 1024 OR ((s[3] // 2 + g[x[1] + 1]) & (CASE WHEN s[2] < 160 THEN 511 ELSE 127 END)) = 0 THEN list_append(list_concat([s[1] + 1, 0, 0], s[4:]), s[1] + 1)
      ELSE list_concat([s[1] + 1, s[2] + 1, s[3] // 2 + g[x[1] + 1]], s[4:]) END) AS s
  FROM obj, gear),
ends AS (SELECT file_id, h, CASE WHEN s[2] > 0 THEN list_append(s[4:], s[1]) ELSE s[4:] END AS e FROM walk),
c AS (SELECT file_id, CAST(i - 1 AS BIGINT) AS chunk_no, CAST(CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END AS BIGINT) AS start, CAST(e[i] AS BIGINT) AS stop, h FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM ends))"""


def _received(size: str) -> str:
    return f"""WITH {_LABEL}, lo AS (SELECT client, version, count(*) AS logical_chunks, {_SUM} AS logical_bytes, count(DISTINCT file_id) AS files, CAST(sum({size}) AS BIGINT) AS got FROM l GROUP BY client, version),
un AS (SELECT client, version, count(*) AS unique_chunks FROM l WHERE first GROUP BY client, version)
SELECT client, version, logical_chunks, logical_bytes, files, coalesce(unique_chunks, 0) AS unique_chunks, got AS received_bytes, got AS sent_bytes FROM lo LEFT JOIN un USING (client, version)"""


def _stats(ctes: str, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""WITH {ctes}, per AS (SELECT {cols}fp, count(*) AS n, max(size) AS one FROM c GROUP BY {cols}fp)
SELECT {cols}CAST(sum(n) AS BIGINT) AS logical_chunks, CAST(sum(n * one) AS BIGINT) AS logical_bytes, CAST(count(*) AS BIGINT) AS unique_chunks, CAST(sum(one) AS BIGINT) AS unique_bytes FROM per{group}"""


ORACLES: dict[str, str] = {
    "chunk_fixed": f"WITH {C256} SELECT file_id, chunk_no, chunk_no * 256 AS start, size, fp FROM c",
    "chunk_fixed_summary": f"WITH {C256} SELECT version, count(*) AS chunks, {_SUM} AS bytes, count(DISTINCT file_id) AS files FROM c GROUP BY version",
    "chunk_pages_fixed": _stats(
        """h AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS h FROM pages),
x AS (SELECT page_id, substr(h, CAST(i * 2048 + 1 AS BIGINT), 2048) AS hx FROM (SELECT *, unnest(generate_series(0, CAST((length(h) // 2 - 1) // 1024 AS BIGINT))) AS i FROM h WHERE length(h) > 0)),
c AS (SELECT CAST(length(hx) // 2 AS BIGINT) AS size, sha256(unhex(hx)) AS fp FROM x)"""
    ),
    "chunk_cdc": f"WITH {_CDC} SELECT file_id, chunk_no, start, stop - start AS size, sha256(unhex(substr(h, 2 * start + 1, 2 * (stop - start)))) AS fp FROM c",
    "cdc_size_histogram": f"WITH {_CDC} SELECT (stop - start) // 64 * 64 AS at_least, count(*) AS chunks, CAST(sum(stop - start) AS BIGINT) AS bytes FROM c GROUP BY 1",
    "chunk_cdc_totals": "SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(octet_length(encode(text)) AS BIGINT) AS last_end FROM documents WHERE text <> ''",
    "fingerprints": "SELECT doc_id, sha256(encode(coalesce(text, ''))) AS sha256, sha1(encode(coalesce(text, ''))) AS sha1, md5(encode(coalesce(text, ''))) AS md5 FROM documents",
    "hmac_fingerprint": """WITH i AS (SELECT doc_id, sha256(unhex('4657454541594452' || repeat('36', 56) || hex(encode(coalesce(text, ''))))) AS inner_fp FROM documents)
SELECT doc_id, sha256(unhex('2c3d2f2f2b332e38' || repeat('5c', 56) || inner_fp)) AS hmac FROM i""",
    "dual_fingerprint": """WITH h AS (SELECT doc_id, sha256(encode(coalesce(text, ''))) AS a, sha256(encode(upper(md5(encode(coalesce(text, '')))))) AS b FROM documents)
SELECT doc_id, sha256(unhex(a || b)) AS dual_fp FROM h""",
    "object_names": "SELECT page_id, sha256(encode(coalesce(url, '') || '7')) AS name FROM pages",
    "padding_seeds": f"SELECT doc_id, {_HALF.format('fp')} AS seed FROM (SELECT doc_id, sha256(encode(coalesce(text, ''))) AS fp FROM documents)",
    "super_features_shingle": f"WITH {_SHINGLES} SELECT fp, max(f) FILTER (WHERE i = 1) AS f0, max(f) FILTER (WHERE i = 2) AS f1, max(f) FILTER (WHERE i = 3) AS f2 FROM feat GROUP BY fp",
    "dedup_first_occurrence": f"WITH {C256} SELECT fp, s.version AS version, s.file_id AS file_id, s.chunk_no AS chunk_no, copies FROM (SELECT fp, min({{'version': version, 'file_id': file_id, 'chunk_no': chunk_no}}) AS s, count(*) AS copies FROM c GROUP BY fp)",
    "dedup_status": f"WITH {_LABEL} SELECT version, CASE WHEN first THEN 'unique' ELSE 'duplicate' END AS status, count(*) AS chunks, {_SUM} AS bytes FROM l GROUP BY ALL",
    "dedup_stats": _stats(C256),
    "dedup_by_client": f"SELECT *, logical_bytes / unique_bytes AS ratio FROM ({_stats(C256, 'client')})",
    "dedup_anti_index": f"WITH {C256} SELECT version, count(*) AS chunks, {_SUM} AS bytes FROM c WHERE version >= 2 AND fp NOT IN (SELECT fp FROM c WHERE version < 2) GROUP BY version",
    "dedup_dual_fp": _stats(C256),
    "dedup_rollup": f"WITH {C256} SELECT client, version, count(*) AS chunks, {_SUM} AS bytes FROM c GROUP BY ROLLUP (client, version)",
    "stats_cumulative": f"""WITH {_LABEL}, v AS (SELECT version, count(*) AS lc, sum(size) AS lb, count(*) FILTER (WHERE first) AS uc, coalesce(sum(size) FILTER (WHERE first), 0) AS ub FROM l GROUP BY version)
SELECT version, CAST(sum(lc) OVER w AS BIGINT) AS logical_chunks, CAST(sum(lb) OVER w AS BIGINT) AS logical_bytes, CAST(sum(uc) OVER w AS BIGINT) AS unique_chunks, CAST(sum(ub) OVER w AS BIGINT) AS unique_bytes
FROM v WINDOW w AS (ORDER BY version ROWS UNBOUNDED PRECEDING)""",
    "similar_precheck": f"WITH {_SHINGLES} SELECT DISTINCT fp FROM feat WHERE version > 0 AND f IN (SELECT f FROM feat WHERE version = 0)",
    "base_vote": f"""WITH {_SHINGLES}, own AS (SELECT f, min(fp) AS base FROM feat WHERE version = 0 GROUP BY f),
per AS (SELECT feat.fp, own.base, count(*) AS votes, min(feat.i) AS pos FROM feat JOIN own USING (f) WHERE feat.version > 0 GROUP BY feat.fp, own.base)
SELECT fp, base, votes FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY votes DESC, pos, base DESC) AS rn FROM per) WHERE rn = 1""",
    "base_greedy": f"WITH {_GREEDY} SELECT fp, base_fp FROM gr",
    "similarity_keys": f"WITH {_GREEDY} SELECT fp, sha256(unhex(repeat('01', 32) || array_to_string(list_transform(fs, lambda x: {_LE}), ''))) AS seed, base IS NOT NULL AS similar FROM gr",
    "key_index_size": f"WITH {_GREEDY} SELECT count(*) AS generated, count(base) AS similar, (count(*) - count(base)) * 120 AS key_index_bytes FROM gr",
    "delta_roundtrip": f"WITH {_GREEDY} SELECT true AS same, count(*) AS chunks FROM gr WHERE base IS NOT NULL HAVING count(*) > 0",
    "chunk_keys": f"""WITH {C256}, k AS (SELECT *, sha256(unhex(repeat('01', 32) || fp)) AS mle, {_HALF.format('fp')} AS seed FROM c)
SELECT file_id, chunk_no, repeat('00', 32) AS plain, mle, sha256(unhex(substr(rpad(hx, 64, '0'), 1, 64) || fp)) AS chunk_key,
       substr(mle, 1, 56) || lower(printf('%02x%02x0000', seed % 256, seed // 256)) AS elc FROM k""",
    "two_phase_roundtrip": f"WITH {C256} SELECT count(*) AS chunks, CAST(sum(16 * (size // 16 + 1)) AS BIGINT) AS cipher_bytes, count(*) AS same FROM c",
    "mle_roundtrip": f"WITH {C256} SELECT count(*) AS chunks, {_SUM} AS cipher_bytes, count(*) AS same FROM c",
    "block_modes_roundtrip": f"""WITH {C256} SELECT count(*) AS chunks, CAST(sum(16 * (size // 16 + 1)) AS BIGINT) AS ecb_bytes, count(*) AS ecb_same, CAST(sum(16 * (size // 16 + 2)) AS BIGINT) AS cbc_bytes, count(*) AS cbc_same,
       CAST(sum(size + 28) AS BIGINT) AS gcm_bytes, count(*) AS gcm_same FROM c""",
    "compress_roundtrip": f"WITH {C1024} SELECT count(*) AS chunks, {_SUM} AS bytes, count(*) AS same FROM c",
    "pad_roundtrip": f"WITH {C1024} SELECT count(*) AS chunks, count(*) AS same, count(*) AS same_size FROM c",
    "container_pack": _PACK + " SELECT doc_id, container_no, at_byte FROM w",
    "container_stats": _PACK + " SELECT count(DISTINCT container_no) AS containers, CAST(sum(at_byte) AS BIGINT) AS sum_offsets FROM w",
    "container_fetch": "SELECT doc_id, sha256(encode(coalesce(text, ''))) AS fp FROM documents",
    "recipe_build": f"WITH {C256} SELECT version, file_id, chunk_no, fp FROM c",
    "recipe_head": f"WITH {C256} SELECT version, file_id, {_SUM} AS size, count(*) AS chunk_num FROM c GROUP BY version, file_id",
    "pipeline_plain_fixed_counts": f"""WITH {_LABEL}, lo AS (SELECT client, version, count(*) AS logical_chunks, {_SUM} AS logical_bytes, count(DISTINCT file_id) AS files FROM l GROUP BY client, version),
un AS (SELECT client, version, count(*) AS unique_chunks, {_SUM} AS unique_bytes FROM l WHERE first GROUP BY client, version)
SELECT client, version, logical_chunks, logical_bytes, files, coalesce(unique_chunks, 0) AS unique_chunks, coalesce(unique_bytes, 0) AS unique_bytes FROM lo LEFT JOIN un USING (client, version)""",
    "restore_check": "SELECT CAST(0 AS BIGINT) AS wrong",
    "store_roundtrip": f"SELECT version, file_id, sha256 FROM ({_RESTORED}) WHERE version = 1",
    "stats_log": _stats(C256, "version"),
    "stats_log_totals": f"""WITH {C256}, v AS (SELECT version, count(*) AS n, sum(size) AS b FROM c GROUP BY version)
SELECT version, CAST(sum(n) OVER w AS BIGINT) AS logical_chunks, CAST(sum(b) OVER w AS BIGINT) AS logical_bytes FROM v WINDOW w AS (ORDER BY version ROWS UNBOUNDED PRECEDING)""",
    "rows_as_backups": _stats(
        """l AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS version, o_orderkey // 4096 AS block, o_orderkey AS k,
         coalesce(CAST(o_orderkey AS VARCHAR), '') || '|' || coalesce(CAST(o_custkey AS VARCHAR), '') || '|' || coalesce(o_orderstatus, '') || '|' || coalesce(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), '')
         || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || coalesce(o_orderpriority, '') AS line FROM orders),
o AS (SELECT version, hex(encode(string_agg(line, chr(10) ORDER BY k, line))) AS h FROM l GROUP BY version, block),
x AS (SELECT version, substr(h, CAST(i * 1024 + 1 AS BIGINT), 1024) AS hx FROM (SELECT *, unnest(generate_series(0, CAST((length(h) // 2 - 1) // 512 AS BIGINT))) AS i FROM o)),
c AS (SELECT version, CAST(length(hx) // 2 AS BIGINT) AS size, sha256(unhex(hx)) AS fp FROM x)""",
        "version",
    ),
    "version_window_index": f"WITH {_WHOLE} SELECT client, feature, version FROM t, cur WHERE now - version < 1",
    "version_window_evicted": f"WITH {_WHOLE} SELECT client, feature, version FROM t, cur WHERE now - version >= 1",
    "cache_refcount": f"""WITH {_WHOLE}, own AS (SELECT c.client, feat.f AS feature, min(c.fp) AS base_fp FROM c JOIN feat USING (fp) GROUP BY ALL),
live AS (SELECT own.client, own.base_fp, count(*) AS refs FROM own JOIN t USING (client, feature), cur WHERE now - t.version < 1 GROUP BY ALL), sz AS (SELECT fp AS base_fp, max(size) AS size FROM c GROUP BY fp)
SELECT client, base_fp, refs, size FROM live JOIN sz USING (base_fp)""",
    "client_cache_sizes": f"""WITH {_WHOLE}, own AS (SELECT c.client, feat.f AS feature, min(c.fp) AS base_fp FROM c JOIN feat USING (fp) GROUP BY ALL),
live AS (SELECT client, feature, base_fp FROM own JOIN t USING (client, feature), cur WHERE now - t.version < 1), sz AS (SELECT fp AS base_fp, max(size) AS size FROM c GROUP BY fp),
held AS (SELECT DISTINCT client, base_fp FROM live)
SELECT client, (SELECT 12 * count(*) FROM live l WHERE l.client = held.client) AS version_index_bytes, count(*) AS cached_chunks, CAST(sum(size) AS BIGINT) AS cached_bytes FROM held JOIN sz USING (base_fp) GROUP BY client""",
    "stream_unique_chunks": f"WITH {C256}, d AS (SELECT DISTINCT client, fp, size FROM c) SELECT client, count(*) AS unique_chunks, {_SUM} AS unique_bytes FROM d GROUP BY client",
    "stream_version_index": f"WITH {C256}, d AS (SELECT fp, min(version) AS version, max(size) AS size FROM c GROUP BY fp) SELECT version, count(*) AS new_chunks, {_SUM} AS new_bytes FROM d GROUP BY version",
    "stream_event_windows": "SELECT date_trunc('day', ts) AS window_start, count(*) AS n_events, CAST(sum(octet_length(encode(props))) AS BIGINT) AS prop_bytes FROM events GROUP BY 1",
}
ORACLES |= {"pipeline_mle_fixed_counts": _received("size"), "pipeline_similar_fixed_counts": _received("16 * (size // 16 + 1)")}
ORACLES["pipeline_full_fixed_counts"] = f"SELECT * EXCLUDE (received_bytes, sent_bytes) FROM ({_received('size')})"
ORACLES |= {f"restore_{m}": _RESTORED for m in ("plain", "mle", "elc", "similar", "similar_comp", "full", "fixed_plain")}

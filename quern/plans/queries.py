"""The engine's queries over the tables, each over whole tables: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import BACKUP, ReductionConfig
from quern.functions import hashes
from quern.operators import chunk as chunks
from quern.operators import codecs, crypto, dedup, keys, pack, similarity, versions
from quern.plans import pipelines
from quern.plans.oracles import ORACLES
from quern.ship import ship
from quern.sources import objects as sources
from quern.sources import store
from quern.streaming import versions as streams
from quern.tables import new_path, release, settle

CFG = ReductionConfig()
SIZE = 256
KEY = bytes(range(32))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return sources.documents(spark, sf)


def _bytes(column: str = "text") -> Column:
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def _fixed(spark: SparkSession, sf: str, size: int = SIZE) -> DataFrame:
    return chunks.fixed(_objects(spark, sf), size).withColumn("fp", F.sha2("data", 256))


# chunking


@query
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf).select("file_id", "chunk_no", "start", F.col("size").cast("long").alias("size"), "fp")


@query
def chunk_fixed_summary(spark: SparkSession, sf: str) -> DataFrame:
    per = _fixed(spark, sf).groupBy("version").agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"), F.countDistinct("file_id").alias("files"))
    return per.select("version", "chunks", "bytes", "files")


@query
def chunk_pages_fixed(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    objects = sources.from_table(pages, F.col("page_id"), F.col("html"), F.regexp_extract("url", r"^\w+://([^/]+)", 1), F.lit(0))
    return dedup.stats(chunks.fixed(objects, 1024).withColumn("fp", F.sha2("data", 256)))


@query
def chunk_cdc(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.content_defined(_objects(spark, sf)).select("file_id", "chunk_no", "start", F.col("size").cast("long").alias("size"), F.sha2("data", 256).alias("fp"))


@query
def chunk_cdc_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Content-defined chunks put together again have each object's size and no gap."""
    rows = chunks.content_defined(_objects(spark, sf))
    return rows.groupBy("file_id").agg(F.sum("size").cast("long").alias("bytes"), F.max(F.col("start") + F.col("size")).alias("last_end"))


@query
def cdc_size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks.content_defined(_objects(spark, sf))
    return rows.groupBy((F.floor(F.col("size") / 64) * 64).alias("at_least")).agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"))


# hashes and sketches


@query
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    b = _bytes()
    return _docs(spark, sf).select("doc_id", *[hashes.digest(b, k).alias(k) for k in ("sha256", "sha1", "md5")])


@query
def hmac_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", hashes.hmac_sha256(_bytes()).alias("hmac"))


@query
def dual_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", hashes.dual_fingerprint(_bytes(), F.encode(F.upper(F.md5(_bytes())), "UTF-8")).alias("dual_fp"))


@query
def object_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", hashes.object_id(F.coalesce("url", F.lit("")), F.lit(7)).alias("name"))


@query
def padding_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", hashes.byte_sum(F.sha2(_bytes(), 256)).alias("seed"))


@query
def xxh64_zero(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return _docs(spark, sf).select("doc_id", hashes.xxh64(_bytes()).alias("xxh64"))


@query
def super_features_rabin(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fixed(spark, sf, 1024)
    return rows.select("file_id", "chunk_no", hashes.super_features(F.col("data"), CFG.sketch).alias("features")).select("file_id", "chunk_no", *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


def _shingled(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct chunks of 1024 bytes with their features in SQL terms; seq is the chunk's rank by fingerprint."""
    rows = _fixed(spark, sf, 1024).groupBy("fp").agg(F.any_value("data").alias("data"), F.min("version").alias("version"))
    return rows.select("fp", "version", hashes.shingle_features(F.col("data")).alias("features"))


@query
def super_features_shingle(spark: SparkSession, sf: str) -> DataFrame:
    return _shingled(spark, sf).select("fp", *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


# deduplication


@query
def dedup_first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_occurrence(_fixed(spark, sf)).select("fp", "seq.*", "copies")


@query
def dedup_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedup.label(_fixed(spark, sf).select("version", "file_id", "chunk_no", "fp", "size"))
    return rows.groupBy("version", "status").agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"))


@query
def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.stats(_fixed(spark, sf))


@query
def dedup_by_client(spark: SparkSession, sf: str) -> DataFrame:
    found = dedup.stats(_fixed(spark, sf), ("client",))
    return found.withColumn("ratio", F.col("logical_bytes") / F.col("unique_bytes"))


@query
def dedup_anti_index(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the last versions that the index of versions 0 and 1 doesn't hold."""
    rows = _fixed(spark, sf)
    index = rows.where("version < 2").select("fp").distinct()
    new = dedup.against_index(rows.where("version >= 2"), index)
    return new.groupBy("version").agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"))


@query
def dedup_dual_fp(spark: SparkSession, sf: str) -> DataFrame:
    """Dedup on the dual fingerprint of a chunk and its MD5: as many unique chunks as by its own."""
    rows = _fixed(spark, sf).withColumn("fp", hashes.dual_fingerprint(F.col("data"), F.encode(F.md5("data"), "UTF-8")))
    return dedup.stats(rows)


@query
def dedup_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Logical chunks and bytes by client and version, with subtotals."""
    rows = _fixed(spark, sf).rollup("client", "version").agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"))
    return rows.select("client", "version", "chunks", "bytes")


@query
def stats_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals after each version: logical, and unique as each version finds it."""
    rows = dedup.label(_fixed(spark, sf).select("version", "file_id", "chunk_no", "fp", "size"))
    first = F.col("status") == "unique"
    per = rows.groupBy("version").agg(F.count("*").alias("logical_chunks"), F.sum("size").alias("logical_bytes"), F.count_if(first).alias("unique_chunks"), F.coalesce(F.sum(F.when(first, F.col("size"))), F.lit(0)).alias("unique_bytes"))
    return pipelines.cumulative(per, ["logical_chunks", "logical_bytes", "unique_chunks", "unique_bytes"])


# similarity


@query
def similar_precheck(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of later versions that share a feature with version 0."""
    rows = settle(_shingled(spark, sf), "shingled")
    index = rows.where("version = 0").select(F.explode("features").alias("feature")).distinct()
    return similarity.precheck(rows.where("version > 0"), index, "fp")


@query
def base_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The base that wins each later chunk's vote; a feature's owner is the least fingerprint of version 0 that has it."""
    rows = settle(_shingled(spark, sf), "shingled")
    owners = rows.where("version = 0").select(F.explode("features").alias("feature"), "fp").groupBy("feature").agg(F.min("fp").alias("base"))
    return similarity.vote(rows.where("version > 0"), owners, "fp").select("fp", "base", F.col("votes").cast("long").alias("votes"))


def _sketched(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks.content_defined(_objects(spark, sf)).withColumn("fp", F.sha2("data", 256))
    once = rows.groupBy("fp").agg(F.min(F.struct("version", "file_id", "chunk_no")).alias("place"), F.any_value("data").alias("data"), F.any_value("size").alias("size"))
    placed = once.orderBy("place").withColumn("seq", F.monotonically_increasing_id())
    return settle(placed.select("seq", "fp", "size", "data", hashes.super_features(F.col("data"), CFG.sketch).alias("features")), "sketched")


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct chunks of 1024 bytes in order of their first place, with their features in SQL terms as longs."""
    once = _fixed(spark, sf, 1024).groupBy("fp").agg(F.min(F.struct("version", "file_id", "chunk_no")).alias("place"), F.any_value("data").alias("data"), F.any_value("size").alias("size"))
    placed = once.orderBy("place").withColumn("seq", F.monotonically_increasing_id())
    longs = F.transform(hashes.shingle_features(F.col("data")), lambda f: F.conv(F.substring(f, 1, 15), 16, 10).cast("long"))
    return settle(placed.select("seq", "fp", "size", "data", longs.alias("features")), "placed")


def _greedy(rows: DataFrame) -> DataFrame:
    found = similarity.assign_bases(rows, CFG.greedy_rounds, CFG.group_rows)
    return found.join(rows.select("seq", "fp"), "seq").join(rows.select(F.col("seq").alias("base"), F.col("fp").alias("base_fp")), "base", "left").select("fp", "base_fp")


@query
def base_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return _greedy(_placed(spark, sf))


@query
def base_greedy_rabin(spark: SparkSession, sf: str) -> DataFrame:
    """The bases of content-defined chunks by their Rabin super-features."""
    return _greedy(_sketched(spark, sf))


# keys and encryption


@query
def chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every key rule that needs no index, over fixed chunks."""
    rows = _fixed(spark, sf)
    mle = keys.message_locked(F.col("fp"), CFG.secret)
    return rows.select(
        "file_id", "chunk_no", F.lower(F.hex(keys.plain_key())).alias("plain"), F.lower(F.hex(mle)).alias("mle"),
        F.lower(F.hex(keys.chunk_key(F.col("data"), F.unhex("fp")))).alias("chunk_key"), F.lower(F.hex(keys.perturbed(mle, hashes.byte_sum(F.col("fp"))))).alias("elc"),
    )


@query
def similarity_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = _placed(spark, sf)
    seeds = keys.similarity_seeds(rows, CFG)
    return rows.join(seeds, "seq").select("fp", F.lower(F.hex("seed")).alias("seed"), F.col("base").isNotNull().alias("similar"))


@query
def key_index_size(spark: SparkSession, sf: str) -> DataFrame:
    seeds = keys.similarity_seeds(_placed(spark, sf), CFG)
    n, similar = F.count("*"), F.count("base")
    return seeds.agg(n.alias("generated"), similar.alias("similar"), pipelines.index_sizes(F.lit(0), n, similar)["key_index_bytes"].alias("key_index_bytes"))


def _same(a: Column, b: Column) -> Column:
    return F.count_if(F.sha2(a, 256) == F.sha2(b, 256))


@query
def two_phase_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fixed(spark, sf).withColumn("key", keys.chunk_key(F.col("data"), F.unhex("fp")))
    rows = rows.withColumn("cipher", crypto.two_phase(F.col("data"), F.col("key"), SIZE))
    return rows.agg(F.count("*").alias("chunks"), F.sum(F.octet_length("cipher")).cast("long").alias("cipher_bytes"), _same(crypto.two_phase_inverse(F.col("cipher"), F.col("key"), SIZE), F.col("data")).alias("same"))


@query
def mle_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fixed(spark, sf).withColumn("key", keys.message_locked(F.col("fp"), CFG.secret))
    rows = rows.withColumn("cipher", crypto.counter_mode(F.col("data"), F.col("key"), SIZE))
    return rows.agg(F.count("*").alias("chunks"), F.sum(F.octet_length("cipher")).cast("long").alias("cipher_bytes"), _same(crypto.counter_mode(F.col("cipher"), F.col("key"), SIZE), F.col("data")).alias("same"))


@query
def block_modes_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fixed(spark, sf)
    out = []
    for mode in ("ECB", "CBC", "GCM"):
        cipher = crypto.block_mode(F.col("data"), F.lit(KEY), mode)
        out += [F.sum(F.octet_length(cipher)).cast("long").alias(f"{mode.lower()}_bytes"), _same(crypto.block_mode_inverse(cipher, F.lit(KEY), mode), F.col("data")).alias(f"{mode.lower()}_same")]
    return rows.agg(F.count("*").alias("chunks"), *out)


# compression and deltas


@query
def compress_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fixed(spark, sf, 1024).withColumn("c", codecs.compress(F.col("data"), CFG.zstd_level))
    return rows.agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"), _same(codecs.decompress(F.col("c.payload"), F.col("c.packed")), F.col("data")).alias("same"))


@query
def compress_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fixed(spark, sf, 1024).withColumn("c", codecs.compress(F.col("data"), CFG.zstd_level))
    return rows.groupBy("client").agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"), F.sum(F.octet_length("c.payload")).cast("long").alias("packed_bytes"), F.count_if(~F.col("c.packed")).alias("raw_chunks"))


@query
def pad_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Padded, then cut again, with the size that the padding rule gives."""
    rows = _fixed(spark, sf, 1024).withColumn("c", codecs.compress(F.col("data"), CFG.zstd_level)).withColumn("seed", hashes.byte_sum(F.col("fp")))
    rows = rows.withColumn("padded", codecs.pad(F.col("c.payload"), F.col("size"), F.col("seed"), CFG.most_padding))
    size = F.octet_length("c.payload") + codecs.padding_bytes(F.col("size"), F.octet_length("c.payload"), F.col("seed"), CFG.most_padding) + 4
    return rows.agg(F.count("*").alias("chunks"), _same(codecs.unpad(F.col("padded")), F.col("c.payload")).alias("same"), F.count_if(F.octet_length("padded") == size).alias("same_size"))


def _deltas(rows: DataFrame) -> DataFrame:
    found = similarity.assign_bases(rows, CFG.greedy_rounds, CFG.group_rows).where("base is not null")
    both = found.join(rows.select("seq", "data", "size"), "seq").join(rows.select(F.col("seq").alias("base"), F.col("data").alias("base_data")), "base")
    return both.withColumn("delta", codecs.delta_encode(F.col("base_data"), F.col("data")))


@query
def delta_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _deltas(_placed(spark, sf))
    return rows.select((F.sha2(codecs.delta_decode(F.col("base_data"), F.col("delta")), 256) == F.sha2("data", 256)).alias("same")).groupBy("same").agg(F.count("*").alias("chunks"))


@query
def delta_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _deltas(_sketched(spark, sf)).agg(F.count("*").alias("similar_chunks"), F.sum("size").cast("long").alias("bytes"), F.sum(F.octet_length("delta")).cast("long").alias("delta_bytes"))


# containers, recipes, restore


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return docs.select(F.lit("all").alias("client"), F.col("doc_id").alias("seq"), F.octet_length(_bytes()).alias("size"))


@query
def container_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack.next_fit(_sizes(spark, sf), 65536).select(F.col("seq").alias("doc_id"), "container_no", F.col("at").alias("at_byte"))


@query
def container_stats(spark: SparkSession, sf: str) -> DataFrame:
    placed = pack.next_fit(_sizes(spark, sf), 65536)
    return placed.agg(F.countDistinct("container_no").alias("containers"), F.sum("at").cast("long").alias("sum_offsets"))


@query
def container_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed into container bodies and read back by their addresses."""
    docs = _docs(spark, sf).select(F.lit("all").alias("client"), F.col("doc_id").alias("seq"), F.sha2(_bytes(), 256).alias("fp"), F.octet_length(_bytes()).alias("size"), _bytes().alias("payload"))
    addr = settle(pack.addresses(docs.drop("payload"), 65536), "addr")
    bodies = settle(pack.container_bodies(addr.join(docs.select("seq", "payload"), "seq")), "bodies")
    return pack.fetch(addr, bodies).select(F.col("seq").alias("doc_id"), F.sha2("payload", 256).alias("fp"))


@query
def recipe_build(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf).select("version", "file_id", "chunk_no", "fp")


@query
def recipe_head(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf).groupBy("version", "file_id").agg(F.sum("size").cast("long").alias("size"), F.count("*").alias("chunk_num"))


def _restored(method: str, chunker: str = "cdc") -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cfg = ReductionConfig(chunker=chunker)
        result = pipelines.upload(_objects(spark, sf), method, cfg)
        restored = pipelines.restore(result, cfg)
        release(result.keys, result.addr, result.containers)
        return restored.select("version", "file_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))

    return run


def _stats(method: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return pipelines.stats(pipelines.upload(_objects(spark, sf), method, CFG))

    return run


for _m in pipelines.METHODS:
    QUERIES[f"restore_{_m}"] = _restored(_m)
    QUERIES[f"pipeline_{_m}_stats"] = _stats(_m)
QUERIES["restore_fixed_plain"] = _restored("plain", "fixed")


@query
def pipeline_plain_fixed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the plain method counts before any codec, by client and version."""
    cfg = ReductionConfig(chunker="fixed")
    found = pipelines.stats(pipelines.upload(_objects(spark, sf), "plain", cfg), ("client", "version"))
    return found.select("client", "version", "logical_chunks", "logical_bytes", "files", "unique_chunks", "unique_bytes")


def _counts(method: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cfg = ReductionConfig(chunker="fixed")
        found = pipelines.stats(pipelines.upload(_objects(spark, sf), method, cfg), ("client", "version"))
        received = [] if method == "full" else ["received_bytes", "sent_bytes"]
        return found.select("client", "version", "logical_chunks", "logical_bytes", "files", "unique_chunks", *received)

    run.__doc__ = "Chunks and bytes by client and version, as they come and as the server receives them."
    return run


for _m in ("mle", "similar", "full"):
    QUERIES[f"pipeline_{_m}_fixed_counts"] = _counts(_m)


@query
def pipeline_full_by_version(spark: SparkSession, sf: str) -> DataFrame:
    found = pipelines.stats(pipelines.upload(_objects(spark, sf), "full", CFG), ("version",))
    return pipelines.cumulative(found, [c for c in found.columns if c != "version"])


@query
def restore_check(spark: SparkSession, sf: str) -> DataFrame:
    """Objects whose restored size differs from the recipe's, by their number (none)."""
    result = pipelines.upload(_objects(spark, sf), "similar", CFG)
    return pipelines.check_restore(pipelines.restore(result, CFG), result).agg(F.count("*").alias("wrong"))


@query
def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The store written, read, and one version restored from it."""
    result = pipelines.upload(_objects(spark, sf), "mle", CFG)
    path = new_path(spark, "store")
    store.save(result, path)
    held = store.load(spark, path)
    again = pipelines.ReductionResult("mle", held["recipe"].where("version = 1"), held["keys"], held["addr"], held["containers"])
    return pipelines.restore(again, CFG).select("version", "file_id", F.sha2("content", 256).alias("sha256"))


@query
def stats_log(spark: SparkSession, sf: str) -> DataFrame:
    """Dedup statistics by version through a CSV log."""
    path = new_path(spark, "log")
    store.write_log(dedup.stats(_fixed(spark, sf), ("version",)), path)
    return store.read_log(spark, path, "version int, logical_chunks long, logical_bytes long, unique_chunks long, unique_bytes long")


@query
def stats_log_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs write their versions' statistics to one log; running totals go on from the first to the second."""
    path, rows = new_path(spark, "log"), _fixed(spark, sf)
    for run in ("version < 2", "version >= 2"):
        store.write_log(dedup.stats(rows.where(run), ("version",)), path)
    log = store.read_log(spark, path, "version int, logical_chunks long, logical_bytes long, unique_chunks long, unique_bytes long")
    return store.totals(log, "version", ["logical_chunks", "logical_bytes"])


@query
def rows_as_backups(spark: SparkSession, sf: str) -> DataFrame:
    """The order table's months as backup versions: whole rows as lines, in objects of 4096 keys, in fixed chunks."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("|", text("o_orderkey"), text("o_custkey"), text("o_orderstatus"), F.coalesce(cents, F.lit("")), F.date_format("o_orderdate", "yyyy-MM-dd"), text("o_orderpriority"))
    objects = sources.rows_as_backups(orders, month, F.col("o_orderkey"), line)
    return dedup.stats(chunks.fixed(objects, 512).withColumn("fp", F.sha2("data", 256)), ("version",))


@query
def files_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The table's own Parquet files as backup files in parts of 64 KiB: what comes, what is unique, what the written files hold."""
    cfg = ReductionConfig(chunk=BACKUP, read_bytes=1 << 16)
    objects = sources.files(spark, sf, pattern="{region,nation,labels,benchmark}*", read_bytes=cfg.read_bytes)
    result = pipelines.upload(objects.drop("path"), "mle", cfg)
    path = new_path(spark, "files")
    store.write_objects(pipelines.restore_chunks(result, cfg), path)
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parts.select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


# version windows


def _current(rows: DataFrame) -> int:
    return rows.agg(F.max("version")).first()[0] or 0


def _feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(client, version, fp, size, feature) of every chunk, by the whole super-features of _shingled."""
    rows = _fixed(spark, sf, 1024).select("client", "version", "fp", F.col("size").cast("long").alias("size"))
    return settle(rows.join(_shingled(spark, sf).select("fp", F.explode(F.array_distinct("features")).alias("feature")), "fp"), "touches")


@query
def version_window_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index by super-features after the table's last version."""
    rows = _feature_rows(spark, sf)
    return versions.live_features(rows, _current(rows), CFG.keep_versions)


@query
def version_window_evicted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_rows(spark, sf)
    return versions.evicted(rows, _current(rows), CFG.keep_versions)


@query
def cache_refcount(spark: SparkSession, sf: str) -> DataFrame:
    """References to each cached base (the least chunk that has a feature) from the live features, and its size."""
    rows = _feature_rows(spark, sf)
    live = versions.live_features(rows, _current(rows), CFG.keep_versions)
    index = rows.groupBy("client", "feature").agg(F.min("fp").alias("base_fp")).join(live, ["client", "feature"], "left_semi")
    return versions.reference_counts(index, rows.groupBy(F.col("fp").alias("base_fp")).agg(F.max("size").alias("size")))


@query
def client_cache_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """By client: bytes of the version index (12 a feature), cached bases, and their bytes."""
    rows = _feature_rows(spark, sf)
    live = versions.live_features(rows, _current(rows), CFG.keep_versions)
    held = cache_refcount(spark, sf).groupBy("client").agg(F.count("*").alias("cached_chunks"), F.sum("size").cast("long").alias("cached_bytes"))
    size = pipelines.index_sizes(F.count("*"), F.lit(0), F.lit(0))["version_index_bytes"].cast("long")
    return live.groupBy("client").agg(size.alias("version_index_bytes")).join(held, "client")


@query
def window_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similar chunks of every client and version under the version window."""
    rows = chunks.content_defined(_objects(spark, sf))
    placed = rows.orderBy("version", "file_id", "chunk_no").withColumn("seq", F.monotonically_increasing_id())
    placed = settle(placed.select("seq", "client", "version", hashes.super_features(F.col("data"), CFG.sketch).alias("features")), "placed")
    found, _ = versions.window_similarity(placed, CFG.keep_versions, CFG.greedy_rounds, CFG.group_rows)
    return placed.join(found, "seq").groupBy("client", "version").agg(F.count("*").alias("chunks"), F.count("base").alias("similar_chunks"))


# streams


def _versions(objects: DataFrame) -> list[int]:
    return [r[0] for r in objects.select("version").distinct().orderBy("version").collect()] or [0]


@query
def stream_unique_chunks(spark: SparkSession, sf: str) -> DataFrame:
    objects = _objects(spark, sf)
    found = streams.stream_unique(objects, _versions(objects), ReductionConfig(chunker="fixed"))
    return found.groupBy("client").agg(F.count("*").alias("unique_chunks"), F.sum("size").cast("long").alias("unique_bytes"))


@query
def stream_version_index(spark: SparkSession, sf: str) -> DataFrame:
    objects = _objects(spark, sf)
    return streams.stream_index(objects, _versions(objects), ReductionConfig(chunker="fixed"))


@query
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.stream_event_windows(spark, sf)


__all__ = ["ORACLES", "QUERIES"]

"""Upload and restore of versioned objects by six methods, as one plan each.

plain, mle (message-locked encryption), elc (compression under encryption), similar (similarity-aware keys,
two-phase encryption), similar_comp (the same over padded compression), full (selective compression by the
client's version window). An object is named by client, version and file. Chunks get a place (seq) in the order of
version, file, client and number, with gaps between objects; joins between
steps carry places, fingerprints and features, and payloads are joined where bytes are needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import ReductionConfig
from quern.functions.hashes import byte_sum, dual_fingerprint, super_features
from quern.operators import codecs, crypto, keys, pack
from quern.operators.chunk import chunk
from quern.operators.similarity import assign_bases
from quern.operators.versions import window_similarity
from quern.ship import ship
from quern.tables import hot_join, numbered, once, release, settle, settle_only, spread

METHODS = ("plain", "mle", "elc", "similar", "similar_comp", "full")


@dataclass(frozen=True)
class ReductionResult:
    """recipe: (client, version, file_id, chunk_no, size, fp, seq, received, sent): received is what the server counts
    of a chunk, sent what crosses the network, the copy for the cache included; keys: (client, version, file_id,
    chunk_no, key, packed); addr: (fp, seq, client, version, kind, base_fp, container_id, offset, length, squeezed, raw);
    containers: (container_id, body, chunks). kind is base, delta (against a base of the client's window in `full`),
    pair (a base stored compressed) or twin_delta (a pair whose compressed form is a delta against another's)."""

    method: str
    recipe: DataFrame
    keys: DataFrame
    addr: DataFrame
    containers: DataFrame


def _sequenced(objects: DataFrame, cfg: ReductionConfig) -> DataFrame:
    parts = ["part"] if "part" in objects.columns else []
    # objects are numbered by their names alone, and chunks within them: no sort carries a payload
    name = ["version", "file_id", "client"]
    order = numbered(objects.select(*name).distinct(), name, "_no").select(*[F.col(c).alias(f"_{c}") for c in name], "_no")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in name])
    placed = spread(objects.select(*name, *parts, "content")).join(order, same).drop(*[f"_{c}" for c in name])
    rows = chunk(placed, cfg).withColumn("seq", F.shiftleft("_no", 32) + F.col("chunk_no"))
    return rows.select("client", "version", "file_id", "chunk_no", "size", "data", "seq")


def _most(cfg: ReductionConfig) -> int:
    """Bytes that key streams must cover: a chunk, its padding and the size behind it."""
    return max(cfg.chunk.most, cfg.chunk.normal) + cfg.most_padding + 20


def _sealed(rows: DataFrame, cfg: ReductionConfig, salt: bytes | None = None) -> DataFrame:
    """Compressed and padded data: column sealed. With a salt the padding is random and goes up to the largest chunk."""
    packed = rows.withColumn("_p", codecs.compress(F.col("data"), cfg.zstd_level))
    upto = F.octet_length("data") if salt is None else F.lit(cfg.chunk.most)
    return packed.withColumn("sealed", codecs.pad(F.col("_p.payload"), upto, F.unhex(F.sha2("data", 256)), cfg.most_padding, salt or b"")).withColumn("packed", F.col("_p.packed")).drop("_p")


def _keyed(rows: DataFrame, method: str, cfg: ReductionConfig) -> DataFrame:
    """Each chunk's key."""
    if method == "plain":
        return rows.withColumn("key", keys.plain_key())
    if method == "mle":
        return rows.withColumn("key", keys.message_locked(F.sha2("data", 256), cfg.secret))
    if method == "elc":
        return rows.withColumn("key", once(F.sha2("data", 256), lambda fp: keys.perturbed(keys.message_locked(fp, cfg.secret), byte_sum(fp))))
    featured = settle(rows.withColumn("plain_features", super_features(F.col("data"), cfg.sketch)), "chunks")
    firsts = featured.groupBy("plain_features").agg(F.min("seq").alias("seq"))
    seeds = settle_only(lambda: keys.similarity_seeds(firsts, cfg, features="plain_features").join(firsts, "seq").select("plain_features", F.col("seed")), "seeds")
    got = hot_join(featured, seeds, ["plain_features"], F.col("seq"))
    return got.withColumn("key", keys.chunk_key(F.col("data"), F.col("seed"))).drop("plain_features", "seed")


def _ciphered(rows: DataFrame, method: str, cfg: ReductionConfig, forms: tuple[str, ...] = ("payload",)) -> DataFrame:
    """What the server receives of rows (data, key): payload, and for `full` the compressed twin, as far as asked for.

    Both follow from data and key, so tables hold these, which are smaller, and ciphers are made where they are read."""
    most = _most(cfg)
    if method == "plain":
        return rows.withColumn("payload", F.col("data")).withColumn("packed", F.lit(False))
    if method == "mle":
        return rows.withColumn("payload", crypto.counter_mode(F.col("data"), F.col("key"), most)).withColumn("packed", F.lit(False))
    if method == "elc":
        return _sealed(rows, cfg, cfg.salt).withColumn("payload", crypto.counter_mode(F.col("sealed"), F.col("key"), most)).drop("sealed")
    if method == "similar":
        return rows.withColumn("payload", crypto.two_phase(F.col("data"), F.col("key"), most)).withColumn("packed", F.lit(False))
    if method == "similar_comp":
        return _sealed(rows, cfg).withColumn("payload", crypto.two_phase(F.col("sealed"), F.col("key"), most)).drop("sealed")
    if "twin" in forms:
        rows = _sealed(rows, cfg).withColumn("twin", crypto.two_phase(F.col("sealed"), F.col("key"), most)).drop("sealed")
    return rows.withColumn("payload", crypto.two_phase(F.col("data"), F.col("key"), most)) if "payload" in forms else rows


def _server_fingerprint(method: str) -> Column:
    """What the server knows a chunk by. Counter mode keeps lengths, so ciphers of different chunks of a byte or two may be
    equal: with `mle` the digest of the key, which the client sends as the chunk's tag, tells them apart."""
    if method == "full":
        return dual_fingerprint(F.col("payload"), F.col("twin"))
    return dual_fingerprint(F.col("payload"), F.col("key")) if method == "mle" else F.sha2("payload", 256)


def _full_kinds(sent: DataFrame, found: DataFrame, firsts: DataFrame, cfg: ReductionConfig) -> DataFrame:
    """(seq, kind, base_fp) of the first places, from what the clients' windows found."""
    named = sent.select(F.col("seq").alias("base"), F.col("sfp").alias("base_fp"))
    # a chunk's base may be a later copy of its own bytes' first place: the fingerprint names it
    base_of = found.where("base is not null").join(named, "base").select("seq", "base_fp")
    linked = settle(firsts.join(base_of, "seq", "left").withColumn("base_fp", F.when(F.col("base_fp") != F.col("sfp"), F.col("base_fp"))), "linked")
    # a base is never itself a delta of the window's: it is stored as a pair
    deep = linked.where("base_fp is not null").select(F.col("base_fp").alias("sfp")).distinct()
    linked = settle(linked.join(deep.withColumn("_deep", F.lit(True)), "sfp", "left").select("seq", F.when(F.col("_deep").isNull(), F.col("base_fp")).alias("base_fp")), "linked")
    # what the window leaves is searched among all clients and versions
    rest = sent.select("seq", "features").join(linked.where("base_fp is null").select("seq"), "seq", "left_semi")
    wide = assign_bases(settle(rest, "rest"), cfg.greedy_rounds, cfg.group_rows).where("base is not null").join(named, "base").select("seq", F.col("base_fp").alias("wide_fp"))
    kind = F.when(F.col("base_fp").isNotNull(), "delta").when(F.col("wide_fp").isNotNull(), "twin_delta").otherwise("pair")
    return linked.join(wide, "seq", "left").select("seq", kind.alias("kind"), F.coalesce("base_fp", "wide_fp").alias("base_fp"))


def _stored(rows: DataFrame, method: str, cfg: ReductionConfig) -> DataFrame:
    """rows (client, version, seq, sfp, kind, base_fp, data, key) as the server stores them: (.., stored, raw).

    A chunk's own bytes, and its base's, are in the form that is coded: compressed but for the window's deltas. Only bases
    that a delta refers to are made."""
    forms = {"payload": "kind = 'delta'", "twin": "kind <> 'delta'"} if method == "full" else {"payload": "true"}
    out = []
    for form, which in forms.items():
        some = rows.where(which)
        columns = ["client", "version", "seq", F.col("sfp").alias("fp"), "kind", "base_fp"]
        made = lambda r, form=form: _ciphered(r, method, cfg, (form,)).withColumn("own", F.col(form))
        coded = some.where("base_fp is not null")
        bases = rows.select(F.col("sfp").alias("base_fp"), "data", "key").join(coded.select("base_fp").distinct(), "base_fp", "left_semi")
        deltas = made(hot_join(coded, made(bases).select("base_fp", F.col("own").alias("base")), ["base_fp"], F.col("seq")))
        out.append(deltas.select(*columns, codecs.delta_encode(F.col("base"), F.col("own")).alias("stored"), F.octet_length("own").alias("raw")))
        out.append(made(some.where("base_fp is null")).select(*columns, F.col("own").alias("stored"), F.octet_length("own").alias("raw")))
    return reduce(DataFrame.unionByName, out)


def upload(objects: DataFrame, method: str, cfg: ReductionConfig = ReductionConfig()) -> ReductionResult:
    """objects (client, version, file_id, content) through one of METHODS.

    Tables go as soon as what is read from them is written."""
    if method not in METHODS:
        raise ValueError(f"no method {method!r}")
    ship(objects.sparkSession)
    full = method == "full"
    forms = {"whole": "payload", "squeezed": "twin"} if full else {"whole": "payload"}
    features = super_features(F.col("payload"), cfg.sketch).alias("features")

    def received() -> DataFrame:
        rows = _ciphered(_keyed(_sequenced(objects, cfg), method, cfg), method, cfg, tuple(forms.values()))
        sizes = [F.octet_length(c).cast("long").alias(n) for n, c in forms.items()]
        return rows.select("client", "version", "file_id", "chunk_no", "size", "seq", "data", "key", "packed", _server_fingerprint(method).alias("sfp"), *sizes, *([features] if full else []))

    sent = settle_only(received, "sent")
    firsts = settle(sent.groupBy("sfp").agg(F.min("seq").alias("seq")), "firsts")
    seen = sent.select("client", "version", "file_id", "chunk_no", "size", F.col("sfp").alias("fp"), "seq", *forms)
    bytes_of = ["client", "version", "seq", "sfp", "data", "key"]
    if full:
        # the client's window decides before anything is known to be a duplicate: every chunk counts
        found = settle_only(lambda: window_similarity(sent.select("seq", "client", "version", "features"), cfg.keep_versions, cfg.greedy_rounds, cfg.group_rows)[0], "window")
        lone = F.col("base").isNull()
        twice = {"received": F.when(lone, F.col("squeezed")).otherwise(F.col("whole")), "sent": F.when(lone, F.col("whole") + F.col("squeezed")).otherwise(F.col("whole"))}
        traffic = seen.join(found, "seq").withColumns(twice)
        kinds = settle_only(lambda: _full_kinds(sent, found, firsts, cfg), "kinds")
        unique, spare = sent, [found]
    else:
        traffic = seen.withColumns({"received": F.col("whole"), "sent": F.col("whole")})
        unique = settle(_ciphered(sent.select(*bytes_of).join(firsts.select("seq"), "seq"), method, cfg).select(*bytes_of, features), "unique")
        named = firsts.select(F.col("seq").alias("base"), F.col("sfp").alias("base_fp"))

        def searched() -> DataFrame:
            based = assign_bases(unique.select("seq", "features"), cfg.greedy_rounds, cfg.group_rows).join(named, "base", "left")
            return based.select("seq", F.when(F.col("base_fp").isNotNull(), "delta").otherwise("base").alias("kind"), "base_fp")

        kinds, spare = settle_only(searched, "kinds"), [unique]
    recipe = settle(traffic.select("client", "version", "file_id", "chunk_no", "size", "fp", "seq", "received", "sent"), "recipe")
    key_rows = settle(sent.select("client", "version", "file_id", "chunk_no", "key", "packed"), "keys")
    rows = settle(unique.select(*bytes_of).join(kinds, "seq"), "rows")
    release(sent, firsts, kinds, *spare)

    coded = settle(_stored(rows, method, cfg).withColumn("squeezed", F.lit(False)), "coded")
    release(rows)
    if method in ("plain", "mle", "elc"):  # the server compresses what it stores
        packed = coded.withColumn("_s", codecs.compress(F.col("stored"), cfg.zstd_level))
        was, coded = coded, settle(packed.withColumn("stored", F.col("_s.payload")).withColumn("squeezed", F.col("_s.packed")).drop("_s"), "coded")
        release(was)
    kept = coded.withColumn("size", F.octet_length("stored"))
    addr = settle(pack.addresses(kept.drop("stored"), cfg.container_bytes), "addr")
    placed = settle(addr.select("seq", "container_id", "offset").join(kept.select("seq", "stored"), "seq").select("container_id", "offset", "stored"), "placed")
    release(coded)
    containers = settle(pack.container_bodies(placed, "stored"), "containers")
    release(placed)
    return ReductionResult(method, recipe, key_rows, addr, containers)


def restore_chunks(result: ReductionResult, cfg: ReductionConfig = ReductionConfig()) -> DataFrame:
    """(client, version, file_id, chunk_no, data) of every chunk of every object: what objects of any size are made of.

    A stored chunk is decrypted once, under the key of any chunk that has it. Of `result` only the recipe is read later than
    this call: who needs no more of it may release() the rest."""
    ship(result.recipe.sparkSession)
    method, most, name = result.method, _most(cfg), ["client", "version", "file_id", "chunk_no"]
    by = result.recipe.join(result.keys, name).groupBy("fp").agg(F.any_value("key").alias("key"), F.any_value("packed").alias("packed"))
    # a base may be of a version that the recipe doesn't hold: it has no key then
    referred = result.addr.where("base_fp is not null").select(F.col("base_fp").alias("fp"), F.lit(True).alias("referred")).distinct()
    keyed = settle(result.addr.join(by, "fp", "left").join(referred, "fp", "left"), "keyed")
    fetch = lambda which: pack.fetch(keyed.where(which), result.containers, "stored")
    # only what deltas and their bases need is kept as it is stored
    lone = fetch("base_fp is null and referred is null and key is not null")
    if method == "full":
        held = settle(lone.select("fp", _unpaired(most).alias("data")), "lone")
        fetched = settle(fetch("(base_fp is not null or referred) and key is not null"), "fetched")
        held = held.unionByName(_full_held(fetched, most))
    else:
        # the server compresses what it stores
        whole = lambda rows: rows.withColumn("stored", codecs.decompress(F.col("stored"), F.col("squeezed"))) if method in ("plain", "mle", "elc") else rows
        data = _decrypted(method, most).alias("data")
        held = settle(whole(lone).select("fp", data), "lone")
        fetched = settle(fetch("base_fp is not null or referred"), "fetched")
        bases = whole(fetched.where("kind = 'base'"))
        linked = bases.select("fp", "key", "packed", "stored").unionByName(_undelta(whole(fetched.where("kind = 'delta' and key is not null")), bases.select("fp", "stored")))
        held = held.unionByName(settle(linked.where("key is not null").select("fp", data), "held"))
    release(keyed, fetched)
    fp = F.unhex("fp").alias("fp")  # half as long on its way
    return hot_join(result.recipe.select(*name, fp), held.select(fp, "data"), ["fp"], F.struct(*name)).select(*name, "data")


def _undelta(deltas: DataFrame, bases: DataFrame) -> DataFrame:
    """deltas (fp, base_fp, stored, key, packed) against bases (fp, stored): (fp, key, packed, stored), stored whole again."""
    some = bases.join(deltas.select(F.col("base_fp").alias("fp")).distinct(), "fp", "left_semi").select(F.col("fp").alias("base_fp"), F.col("stored").alias("base"))
    return hot_join(deltas, some, ["base_fp"], F.col("fp")).select("fp", "key", "packed", codecs.delta_decode(F.col("base"), F.col("stored")).alias("stored"))


def _unpaired(most: int) -> Column:
    """A pair's bytes from its compressed cipher."""
    return codecs.decompress(codecs.unpad(crypto.two_phase_inverse(F.col("stored"), F.col("key"), most)), F.col("packed"))


def _full_held(fetched: DataFrame, most: int) -> DataFrame:
    """(fp, data) of method `full`, over two levels."""
    pairs, columns = fetched.where("kind = 'pair'"), ["fp", "key", "packed", "stored"]
    twins = pairs.select(*columns).unionByName(_undelta(fetched.where("kind = 'twin_delta'"), pairs))
    pairs = settle(twins.select("fp", "key", _unpaired(most).alias("data")), "pairs")
    # a pair's uncompressed cipher, which the window's deltas refer to, is made again
    bases = pairs.select("fp", crypto.two_phase(F.col("data"), F.col("key"), most).alias("stored"))
    local = _undelta(fetched.where("kind = 'delta'"), bases).select("fp", crypto.two_phase_inverse(F.col("stored"), F.col("key"), most).alias("data"))
    return pairs.select("fp", "data").unionByName(settle(local, "local"))


def restore(result: ReductionResult, cfg: ReductionConfig = ReductionConfig()) -> DataFrame:
    """(client, version, file_id, content) of every object with chunks, byte for byte.

    An object is one value here, so 1 GB at most; write larger ones from restore_chunks()."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", "data")))
    made = restore_chunks(result, cfg).groupBy("client", "version", "file_id").agg(parts.alias("p"))
    return made.select("client", "version", "file_id", pack.joined(F.col("p"), "data").alias("content"))


def _decrypted(method: str, most: int) -> Column:
    whole, key = F.col("stored"), F.col("key")
    if method == "plain":
        return whole
    if method == "mle":
        return crypto.counter_mode(whole, key, most)
    if method == "elc":
        return codecs.decompress(codecs.unpad(crypto.counter_mode(whole, key, most)), F.col("packed"))
    if method == "similar_comp":
        return _unpaired(most)
    return crypto.two_phase_inverse(whole, key, most)


def stats(result: ReductionResult, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each group of client, version): what came, what is unique, similar and stored.

    local_* are deltas against a base of the client's window (`full` alone), global_* those against any base."""
    logical = result.recipe.groupBy(*by).agg(
        F.count("*").alias("logical_chunks"), F.sum("size").cast("long").alias("logical_bytes"), F.countDistinct("file_id").alias("files"),
        F.sum("received").cast("long").alias("received_bytes"), F.sum("sent").cast("long").alias("sent_bytes"),
    )
    local = F.col("kind") == "delta" if result.method == "full" else F.lit(False)
    wide = F.col("kind") == ("twin_delta" if result.method == "full" else "delta")
    of = lambda name, kind: [
        F.count_if(kind).alias(f"{name}_chunks"), F.sum(F.when(kind, F.col("raw")).otherwise(0)).cast("long").alias(f"{name}_bytes"),
        F.sum(F.when(kind, F.col("length")).otherwise(0)).cast("long").alias(f"{name}_delta_bytes"),
    ]
    stored = result.addr.groupBy(*by).agg(
        F.count("*").alias("unique_chunks"), F.sum("raw").cast("long").alias("unique_bytes"), *of("local", local), *of("global", wide),
        F.sum("length").cast("long").alias("stored_bytes"), F.countDistinct("container_id").alias("containers"),
    )
    both = logical.unionByName(stored, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in both.columns if c not in by])


def cumulative(per_version: DataFrame, columns: list[str], version: str = "version") -> DataFrame:
    """Running totals by version, as a log line after each upload has them."""
    order = Window.orderBy(version).rowsBetween(Window.unboundedPreceding, 0)
    return per_version.select(version, *[F.sum(c).over(order).cast("long").alias(c) for c in columns])


def index_sizes(n_features: Column, generated: Column, similar: Column) -> dict[str, Column]:
    """Bytes of a client's version index (12 a feature) and of the key index (three entries of 40 a base)."""
    return {"version_index_bytes": n_features * 12, "key_index_bytes": (generated - similar) * 3 * 40}


def check_restore(restored: DataFrame, result: ReductionResult) -> DataFrame:
    """(client, version, file_id, expected, got) of objects whose restored size is not the recipe's."""
    head = result.recipe.groupBy("client", "version", "file_id").agg(F.sum("size").cast("long").alias("expected"))
    got = restored.select("client", "version", "file_id", F.octet_length("content").cast("long").alias("got"))
    return head.join(got, ["client", "version", "file_id"], "full").where(~F.col("expected").eqNullSafe(F.col("got")))

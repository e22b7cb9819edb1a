from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.config import ChunkParams, ReductionConfig
from quern.functions.hashes import hmac_sha256, xxh64
from quern.functions.register import register
from quern.operators import crypto, dedup, keys, pack, similarity, versions
from quern.operators.chunk import chunk, content_defined, fixed
from quern.plans import pipelines
from quern.plans.queries import QUERIES
from quern.sources import objects, store
from quern.tables import components, hot_join, numbered, release, salted_join, scratch_dir, settle, settle_only


def objects_of(spark, rows):
    return spark.createDataFrame([(c, v, f, bytearray(b)) for c, v, f, b in rows], "client string, version int, file_id string, content binary")


def test_chunks_put_together_are_the_object(spark):
    rng = random.Random(5)
    data = [("a", 0, str(i), rng.randbytes(n)) for i, n in enumerate((0, 1, 63, 64, 65, 1000, 5000))]
    for made in (fixed(objects_of(spark, data), 64), content_defined(objects_of(spark, data))):
        got: dict[str, bytes] = {}
        for r in made.orderBy("file_id", "chunk_no").collect():
            assert r["size"] == len(r["data"]) and r["start"] == len(got.get(r["file_id"], b""))
            got[r["file_id"]] = got.get(r["file_id"], b"") + bytes(r["data"])
        assert got == {f: b for _, _, f, b in data if b}


def test_null_content_has_no_chunk(spark):
    df = spark.createDataFrame([("1", None), ("2", bytearray(b"abc"))], "file_id string, content binary")
    for made in (fixed(df, 2), content_defined(df)):
        assert {r["file_id"] for r in made.collect()} == {"2"}


def test_first_occurrence_by_order_and_status(spark):
    rows = [(1, "b", 0, "x", 5), (0, "z", 3, "x", 5), (0, "a", 9, "y", 2), (1, "b", 1, "x", 5)]
    df = spark.createDataFrame(rows, "version int, file_id string, chunk_no long, fp string, size int")
    assert {(r["version"], r["chunk_no"]): r["status"] for r in dedup.label(df).collect()} == {(1, 0): "duplicate", (0, 3): "unique", (0, 9): "unique", (1, 1): "duplicate"}
    assert dedup.stats(df).first().asDict() == {"logical_chunks": 4, "logical_bytes": 17, "unique_chunks": 2, "unique_bytes": 7}


def sequential(chunks):
    """The rule of the survey, one chunk after another: {seq: base or None}."""
    owner, out = {}, {}
    for seq, features in sorted(chunks):
        votes, first = {}, None
        for f in features:
            if f in owner:
                votes[owner[f]] = votes.get(owner[f], 0) + 1
                first = owner[f] if first is None else first
        if votes:
            best = max(votes.values())
            out[seq] = first if best == 1 else next(b for b, n in votes.items() if n == best)
        else:
            out[seq] = None
            for f in features:
                owner[f] = seq
    return out


@pytest.mark.parametrize("seed", range(2))
def test_greedy_bases_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(60) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, features array<long>")
    want = sequential(rows)
    for most in (4, 30, 100_000):  # by rounds, by components, by one walk
        got = {r["seq"]: r["base"] for r in similarity.assign_bases(df, rounds=2, group_rows=most).collect()}
        assert got == want


def test_greedy_chain_falls_back_to_components(spark):
    rows = [(i, [i, i + 1, 10_000 + i]) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, features array<long>")
    assert {r["seq"]: r["base"] for r in similarity.assign_bases(df, rounds=2, group_rows=59).collect()} == sequential(rows)
    apart = spark.createDataFrame(rows[:30] + rows[40:], "seq long, features array<long>")
    assert {r["seq"]: r["base"] for r in similarity.assign_bases(apart, rounds=1, group_rows=40).collect()} == sequential(rows[:30] + rows[40:])


def test_vote_ties(spark):
    owners = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q"), (4, "r")], "feature long, base string")
    rows = spark.createDataFrame([("one", [4, 1, 9]), ("two", [1, 2, 3]), ("none", [7, 8, 9]), ("same", [1, 1, 4])], "fp string, features array<long>")
    got = {r["fp"]: (r["base"], r["votes"]) for r in similarity.vote(rows, owners, "fp").collect()}
    assert got == {"one": ("r", 1), "two": ("q", 2), "same": ("p", 2)}


def test_window_forgets_what_a_version_does_not_touch(spark):
    rows = [(0, "a", 0, [1, 2, 3]), (1, "a", 1, [7, 8, 9]), (2, "a", 2, [1, 2, 3]), (3, "a", 2, [1, 5, 6]), (4, "b", 2, [1, 2, 3]), (5, "a", 3, [3, 0, 0])]
    df = spark.createDataFrame(rows, "seq long, client string, version int, features array<long>")
    got = {r["seq"]: r["base"] for r in versions.window_similarity(df)[0].collect()}
    assert got == {0: None, 1: None, 2: None, 3: 2, 4: None, 5: 2}
    longer = {r["seq"]: r["base"] for r in versions.window_similarity(df, keep=3)[0].collect()}
    assert longer[2] == 0 and longer[5] == 0


def test_next_fit(spark):
    rows = [("a", 0, 60), ("a", 1, 50), ("a", 2, 40), ("a", 3, 200), ("a", 4, 1), ("b", 5, 10)]
    df = spark.createDataFrame(rows, "client string, seq long, size long")
    got = {r["seq"]: (r["container_no"], r["at"]) for r in pack.next_fit(df, 100).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (1, 50), 3: (2, 0), 4: (3, 0), 5: (0, 0)}


def test_containers_whose_names_share_their_first_digits(spark):
    # SHA-256 of all:57784 and all:82608 share their first 8 hex digits
    rows = spark.range(82_609).select(F.lit("all").alias("client"), F.col("id").alias("seq"), F.lit(4).cast("long").alias("size"), F.encode(F.lpad(F.hex("id"), 8, "0"), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload", F.substring("payload", 5, 4))
    addr = pack.addresses(rows.drop("payload"), 4)
    some = addr.where("seq in (57784, 82608)")
    bodies = pack.container_bodies(some.join(rows.select("seq", "payload"), "seq"))
    got = {r["seq"]: (r["container_no"], bytes(r["payload"])) for r in pack.fetch(some, bodies).collect()}
    assert got == {i: (i, f"{i:08X}"[4:].encode()) for i in (57784, 82608)}


def test_window_queries_have_whole_features(spark, tmp_path):
    # 400 chunks a version of one client, none of the first in the last: two digits of a fingerprint are all touched again
    rng = random.Random(11)
    texts = [(i, f"src{25 * (i >= 400)}", "".join(rng.choices("abcdefghij", k=60))) for i in range(800)]
    spark.createDataFrame([(i, t, "en", s) for i, s, t in texts], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    live, gone = (QUERIES[f"version_window_{n}"](spark, str(tmp_path)).collect() for n in ("index", "evicted"))
    assert {r["version"] for r in live} == {5} and {r["version"] for r in gone} == {0} and len(live) > 1000 < len(gone)
    assert all(len(r["feature"]) == 32 for r in live + gone) and not {r["feature"] for r in live} & {r["feature"] for r in gone}
    assert QUERIES["cache_refcount"](spark, str(tmp_path)).count() > 256


def test_queries_take_every_version_of_the_table(spark, tmp_path):
    first, second, third = ("".join(random.Random(i).choices("abcdefghij", k=80)) for i in range(3))  # long enough to share no feature
    rows = [(0, "src0", first), (1, "src7", second), (2, "src27", third), (3, "src27", first)]
    spark.createDataFrame([(i, t, "en", s) for i, s, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert run("stream_unique_chunks")[0]["unique_chunks"] == 3
    assert {r["version"]: r["new_chunks"] for r in run("stream_version_index")} == {0: 1, 1: 1, 5: 1}
    assert {r["version"] for r in run("version_window_index")} == {5} and {r["version"] for r in run("version_window_evicted")} == {1}
    assert len(run("cache_refcount")) == 2


def test_block_cipher_vector_and_counter_mode(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([(bytearray(bytes.fromhex("00112233445566778899aabbccddeeff")),)], "data binary")
    row = df.select(F.hex(crypto.block_mode(F.col("data"), F.lit(key), "ECB")).alias("e"), F.hex(crypto.counter_mode(F.lit(bytes(16)), F.lit(key), 16)).alias("c"), F.hex(crypto.block_mode(F.lit(bytes(16)), F.lit(key), "ECB")).alias("z")).first()
    assert row["e"].startswith("8EA2B7CA516745BFEAFC49904B496089")
    assert row["c"] == row["z"][:32]  # the first counter is 0
    with pytest.raises(ValueError):
        crypto.block_mode(F.col("data"), F.lit(key), "XTS")


@pytest.mark.parametrize("n", [1, 15, 16, 17, 550, 8192])
def test_two_phase_roundtrip(spark, n):
    data = random.Random(n).randbytes(n)
    df = spark.createDataFrame([(bytearray(data),)], "data binary")
    cipher = df.select(crypto.two_phase(F.col("data"), F.lit(b"\1" * 32), 8192).alias("c"))
    row = cipher.select(F.octet_length("c").alias("n"), crypto.two_phase_inverse(F.col("c"), F.lit(b"\1" * 32), 8192).alias("d")).first()
    assert row["n"] == 16 * (n // 16 + 1) and bytes(row["d"]) == data


def test_hmac_and_keys(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([(bytearray(b"abc"), [1, -1])], "d binary, f array<long>")
    row = df.select(hmac_sha256(F.col("d")).alias("h"), keys.feature_bytes(F.col("f")).alias("f"), keys.chunk_key(F.col("d"), F.lit(b"s")).alias("k")).first()
    assert row["h"] == hmac.new(b"password", b"abc", "sha256").hexdigest()
    assert bytes(row["f"]) == (1).to_bytes(8, "little") + b"\xff" * 8
    assert bytes(row["k"]) == hashlib.sha256(b"abc".ljust(32, b"\0") + b"s").digest()


def test_similar_chunks_share_their_seed(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [3, 4, 5]), (2, [9, 8, 7])], "seq long, features array<long>")
    got = {r["seq"]: (bytes(r["seed"]), r["base"]) for r in keys.similarity_seeds(df, ReductionConfig()).collect()}
    assert got[0][0] == got[1][0] != got[2][0] and got[1][1] == 0


def versions_of(rng):
    one = rng.randbytes(9000)
    two = bytearray(one[:4000] + b"changed" + one[4000:])
    two[100:9000:150] = b"#" * len(range(100, 9000, 150))  # in place: chunks stay similar
    two = bytes(two)
    three = rng.randbytes(500) + one[2000:]
    text = b"the same words again and again, " * 300
    return [("a", 0, "x", one), ("a", 0, "t", text), ("a", 1, "x", two), ("a", 2, "x", three), ("a", 3, "x", one), ("b", 1, "x", one), ("b", 1, "copy", one), ("b", 2, "s", b"short"), ("b", 2, "e", b"")]


@pytest.mark.parametrize("method", pipelines.METHODS)
def test_restore_is_byte_exact(spark, method):
    rows = versions_of(random.Random(7))
    cfg = ReductionConfig(chunk=ChunkParams(64, 256, 1024), container_bytes=5000)
    result = pipelines.upload(objects_of(spark, rows), method, cfg)
    got = {(r["client"], r["version"], r["file_id"]): bytes(r["content"]) for r in pipelines.restore(result, cfg).collect()}
    assert got == {(c, v, f): b for c, v, f, b in rows if b}
    s = pipelines.stats(result).first()
    assert s["unique_bytes"] <= s["sent_bytes"] and s["unique_chunks"] < s["logical_chunks"] and s["logical_bytes"] == sum(len(r[3]) for r in rows)
    bases = {r["fp"] for r in result.addr.where("kind <> 'delta'").collect()}
    assert all(r["base_fp"] in bases for r in result.addr.where("kind in ('delta', 'twin_delta')").collect())


def test_short_chunks_with_equal_ciphers_stay_apart(spark):
    """Ciphers of mle are as short as their chunks: of all single bytes some meet, and they are different chunks nevertheless."""
    rows = [("a", i % 2, f"f{i}", bytes([i])) for i in range(256)] + [("b", 1, "again", b"a")]
    result = pipelines.upload(objects_of(spark, rows), "mle")
    s = pipelines.stats(result).first()
    assert (s["logical_chunks"], s["unique_chunks"], s["received_bytes"]) == (257, 256, 257)
    assert {(r["client"], r["file_id"]): bytes(r["content"]) for r in pipelines.restore(result).collect()} == {(c, f): b for c, _, f, b in rows}


def test_restore_several_clients_and_versions(spark, tmp_path):
    rows = [(c, v, f"{c}/{v}/{f}", b) for c, v, f, b in versions_of(random.Random(7))]
    for method in ("plain", "full"):
        result = pipelines.upload(objects_of(spark, rows), method)
        path = str(tmp_path / method)
        store.save(result, path)
        held = store.load(spark, path)
        again = pipelines.ReductionResult(method, *(held[t] for t in store.TABLES))
        assert {r["file_id"]: bytes(r["content"]) for r in pipelines.restore(again).collect()} == {f: b for _, _, f, b in rows if b}
        assert result.addr.where("kind = 'delta'").count() > 0
        assert pipelines.check_restore(pipelines.restore(result), result).count() == 0
        with pytest.raises(store.MissingObject):
            store.require(held["recipe"], ["a/0/x", "nothing"])


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        pipelines.upload(objects_of(spark, []), "none")


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (205, 203), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 203: 203, 205: 203}
    assert components(df.where("a = b")) is None


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 5).alias("k"))
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert salted_join(big, small, ["k"], F.col("id")).count() == 1000
    assert salted_join(big, small, ["k"], F.col("id"), "inner").count() == big.where("k in (1, 2)").count()


def test_files_as_versions(spark, tmp_path):
    for i, name in enumerate(("v2.bin", "v1.bin", "skip.txt")):
        (tmp_path / name).write_bytes(bytes([i]) * 10)
    got = {r["path"].rsplit("/", 1)[1]: (r["version"], bytes(r["content"])) for r in objects.files(spark, str(tmp_path), pattern="*.bin").collect()}
    assert got == {"v1.bin": (0, b"\1" * 10), "v2.bin": (1, b"\0" * 10)}


def test_large_files_come_in_parts(spark, tmp_path):
    rng = random.Random(3)
    held = {"a b.bin": rng.randbytes(5000), "c.bin": rng.randbytes(1000), "d.bin": b"", "e.bin": rng.randbytes(3000)}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    for cfg in (ReductionConfig(read_bytes=1000), ReductionConfig(chunker="fixed", read_bytes=1000)):
        found = objects.files(spark, str(tmp_path), pattern="*.bin", read_bytes=1000)
        assert sorted(found.groupBy("path").count().toPandas()["count"]) == [1, 3, 5]
        made = chunk(found.drop("path"), cfg)
        by = {}
        for r in made.orderBy("version", "chunk_no").collect():
            assert r["start"] == len(by.get(r["version"], b"")) and r["start"] // 1000 == (r["start"] + r["size"] - 1) // 1000
            by[r["version"]] = by.get(r["version"], b"") + bytes(r["data"])
        assert by == {i: held[n] for i, n in enumerate(("a b.bin", "c.bin", "e.bin"))}
        result = pipelines.upload(found.drop("path"), "plain", cfg)
        out = store.write_objects(pipelines.restore_chunks(result, cfg), str(tmp_path / f"out-{cfg.chunker}")).collect()
        assert sorted(r["size"] for r in out) == [1000, 3000, 5000]
        assert {open(r["path"], "rb").read() for r in out} == {d for d in held.values() if d}


def test_rows_as_backups(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c"), (1, 9, "d")], "m int, k int, s string")
    got = {r["file_id"]: bytes(r["content"]).decode() for r in objects.rows_as_backups(df, F.col("m"), F.col("k"), F.concat_ws("|", "k", "s"), keys=5).collect()}
    assert got == {"1:0": "1|a\n2|b", "1:1": "9|d", "2:0": "3|c"}


def test_columns_named_like_a_chunk_s_give_way(spark):
    df = spark.createDataFrame([("f", bytearray(b"abcd" * 40), 7, "x", 1, 2, 3)], "file_id string, content binary, size int, start string, _at int, _ends int, _piece int")
    for made in (fixed(df, 64), content_defined(df)):
        assert sorted(made.columns) == sorted(["file_id", "_at", "_ends", "_piece", "chunk_no", "start", "size", "data"])
        rows = made.orderBy("chunk_no").collect()
        assert b"".join(bytes(r["data"]) for r in rows) == b"abcd" * 40 and {(r["_at"], r["_ends"], r["_piece"]) for r in rows} == {(1, 2, 3)}


def test_numbers_have_no_gap(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert {(r["k"], r["n"]) for r in numbered(df, ["k"], "n").collect()} == {(i, i) for i in range(1000)}


def test_hot_keys_are_dealt_out(spark):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 9).alias("k"))
    small = spark.createDataFrame([(i, f"v{i}") for i in range(1, 9)], "k long, v string")
    for hot in (10, 100_000):
        got = hot_join(big, small, ["k"], F.col("id"), hot).collect()
        assert len(got) == big.where("k > 0").count() and all(r["v"] == f"v{r['k']}" for r in got)


def test_a_later_session_goes_on_with_the_window(spark):
    rows = [(0, "a", 0, [1, 2, 3]), (1, "a", 1, [1, 8, 9]), (2, "a", 2, [1, 2, 3]), (3, "a", 2, [9, 5, 6]), (4, "b", 2, [1, 2, 3]), (5, "a", 3, [3, 0, 0])]
    df = spark.createDataFrame(rows, "seq long, client string, version int, features array<long>")
    whole, _ = versions.window_similarity(df)
    first, index = versions.window_similarity(df.where("version < 2"))
    then, _ = versions.window_similarity(df.where("version >= 2"), index=index)
    assert sorted(first.unionByName(then).collect()) == sorted(whole.collect())


@pytest.mark.parametrize("method", ["mle", "full"])
def test_upload_and_restore_keep_only_what_is_read(spark, method):
    """Tables on the way go as soon as what is read from them is written: a restore holds far less than all it has written."""
    held = lambda: {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in Path(scratch_dir(spark).removeprefix("file:")).glob("*-*")}
    before = set(held())
    new = lambda: sorted({n.rpartition("-")[0] for n in held() if n not in before})
    rows = versions_of(random.Random(7))
    result = pipelines.upload(objects_of(spark, rows), method)
    assert new() == ["addr", "containers", "keys", "recipe"]
    got = pipelines.restore(result)
    assert set(new()) <= {"addr", "containers", "keys", "recipe", "held", "lone", "pairs", "local"}
    assert {(r["client"], r["version"], r["file_id"]): bytes(r["content"]) for r in got.collect()} == {(c, v, f): b for c, v, f, b in rows if b}


def test_settle_only_keeps_what_was_there(spark):
    outer = settle(spark.range(3), "outer")

    def make():
        inner = settle(outer.where("id > 0"), "inner")
        made.append(inner)
        return inner.unionByName(outer)

    made = []
    out = settle_only(make, "out")
    assert out.count() == 5 and outer.count() == 3 and not Path(made[0]._settled.removeprefix("file:")).exists()
    release(outer, spark.range(1))
    assert out.count() == 5 and not Path(outer._settled.removeprefix("file:")).exists()


def test_bases_of_other_clients_and_two_levels(spark):
    """full: client b's first chunks are deltas of client a's compressed ones, its next version's deltas of its own."""
    rng = random.Random(5)
    one = "".join(rng.choices("abcdefgh ", k=20_000)).encode()
    edit = lambda b, n: bytes(c if i % n else 35 for i, c in enumerate(b))
    rows = [("a", 0, "x", one), ("b", 0, "y", edit(one, 257)), ("b", 1, "z", edit(edit(one, 257), 211)), ("c", 1, "x", one)]
    result = pipelines.upload(objects_of(spark, rows), "full")
    kinds = {r["fp"]: (r["kind"], r["base_fp"], r["client"]) for r in result.addr.collect()}
    count = Counter((k, c) for k, _, c in kinds.values())
    assert count["twin_delta", "b"] > 0 and count["delta", "b"] > 0 and not count["twin_delta", "a"]
    assert any(k == "delta" and kinds[b][0] == "twin_delta" for k, b, _ in kinds.values())
    assert all(kinds[b][0] == "pair" for k, b, _ in kinds.values() if k == "twin_delta")
    got = {(r["client"], r["file_id"]): bytes(r["content"]) for r in pipelines.restore(result).collect()}
    assert got == {(c, f): b for c, _, f, b in rows}
    s = pipelines.stats(result).first()
    assert s["local_chunks"] == count["delta", "b"] and s["global_chunks"] == sum(n for (k, _), n in count.items() if k == "twin_delta")
    assert s["sent_bytes"] > s["received_bytes"] > 0


def test_index_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in store.upsert_index(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert store.upsert_index(None, new, "k").count() == 2


def test_sql_functions(spark):
    names = register(spark)
    assert "quern_chunks" in names
    data = random.Random(4).randbytes(3000).hex().upper()
    rows = spark.sql(f"select * from quern_chunks(unhex('{data}'))").orderBy("chunk_no").collect()
    assert b"".join(bytes(r["data"]) for r in rows).hex().upper() == data
    row = spark.sql("select quern_cut_points(unhex('00')) c, size(quern_super_features(unhex('0011'))) n, quern_undelta(unhex('0102'), quern_delta(unhex('0102'), unhex('010203'))) d").first()
    assert row["c"] == [1] and row["n"] == 3 and bytes(row["d"]) == b"\1\2\3"


def test_xxh64_seed_zero(spark):
    assert spark.range(1).select(xxh64(F.lit(b"")).alias("h")).first()["h"] == 0xEF46DB3751D8E999 - (1 << 64)


def test_fixed_chunker_setting(spark):
    df = objects_of(spark, [("a", 0, "f", b"x" * 600)])
    assert [r["size"] for r in chunk(df, ReductionConfig(chunker="fixed")).orderBy("chunk_no").collect()] == [256, 256, 88]


def test_restored_objects_as_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "f", 1, bytearray(b"ne")), ("a", 0, "f", 0, bytearray(b"o")), ("b", 2, "g", 0, bytearray())], "client string, version int, file_id string, chunk_no long, data binary")
    rows = store.write_objects(df, str(tmp_path)).collect()
    assert {r["path"].removeprefix(f"{tmp_path}/"): r["size"] for r in rows} == {"a/0/f-d": 3, "b/2/g-d": 0}
    assert (tmp_path / "a/0/f-d").read_bytes() == b"one" and not list(tmp_path.rglob("*.part"))

"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. In round i < t every element of a set is hashed to one coordinate with the
value i + v, v in [0, 1); in round t + j every element goes to coordinate j. A coordinate keeps its least
value, and rounds stop once all coordinates are filled, which takes about t ln t hashed elements whatever
the set's size. Coordinates of two sets agree with probability their Jaccard similarity, with the
concentration of independent hashes. Bands of r coordinates give candidate pairs; candidates are linked
only after their full sets are compared.

Cases: rows whose text is null, empty or without words have the empty set (n_shingles 0) and link with
nothing. Equal sets are one class whatever their ids. Rows may repeat; a null id never becomes a
component's id unless the component has no other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, fresh, salted_join, settle
from quern.ship import ship

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U64 = np.uint64
MEMO_WORDS = 400_000


@dataclass(frozen=True)
class NearDupParams:
    """words a shingle; linked if 100 * |A & B| >= percent * |A | B|; bands of rows coordinates.

    With 48 bands of 7, a pair at similarity 0.85 is missed with probability 9e-9 and one at 0.8 with
    1e-5 (bands_for() gives a table for a lower threshold)."""

    words: int = 3
    percent: int = 85
    bands: int = 48
    rows: int = 7
    block: int = 128  # classes that one verifying task compares with each other
    block_shingles: int = 4_000_000


def bands_for(percent: int, rows: int, miss: float = 1e-8) -> int:
    """The bands of `rows` coordinates that miss a pair at the threshold with probability `miss` at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-((percent / 100) ** rows))))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _WordHash()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole sequence is one if it is shorter."""
    toks = text.translate(LOWER).split() if text else []
    if not toks:
        return np.empty(0, U64)
    h = np.fromiter(map(_memo.__getitem__, toks), U64, len(toks))
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - k + 1, U64(k) * U64(0x9E3779B97F4A7C15), U64)
        for i in range(k):
            s = (s + h[i : len(h) - k + 1 + i]) * U64(0xD6E8FEB86659FD93)
            s ^= s >> U64(32)
    return np.unique(s)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Sketches (len(sets), t) of non-empty sets, all rounds vectorised over the batch."""
    n = len(sets)
    none = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, none, U64)
    active = np.arange(n)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.empty(0, U64)
    owner = np.repeat(np.arange(n), sizes)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            x = mix(flat + U64(i + 1) * U64(0x9E3779B97F4A7C15))
            place = ((x >> U64(32)) * U64(t)) >> U64(32) if i < t else np.full(len(x), i - t, U64)
            np.minimum.at(out, owner * t + place.astype(np.int64), (U64(i) << U64(32)) | (x & U64(0xFFFFFFFF)))
            left = (out.reshape(n, t)[active] == none).any(axis=1)
            if not left.any():
                break
            if not left.all():
                active = active[left]
                on = np.zeros(n, bool)
                on[active] = True
                keep = on[owner]
                flat, owner = flat[keep], owner[keep]
    return out.reshape(n, t)


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)), (len(sk), bands)).copy()
        for r in range(rows):
            key = mix((key ^ sk[:, r : bands * rows : rows]) * U64(0xD6E8FEB86659FD93) + U64(1))
    return key.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sketcher(p: NearDupParams):
    t = p.bands * p.rows
    schema = pa.schema([("rk", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("nid", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else None, p.words) for x in b["text"].cast(pa.binary())]
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = [_digest(s) if len(s) else None for s in sets]
                keys = iter(band_keys(sketch([sets[i] for i in full], t), p.bands, p.rows))
                yield pa.record_batch(
                    [
                        b["rk"], b["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()),
                        pa.array([g and int.from_bytes(g[:8], "little", signed=True) for g in sigs], pa.int64()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return run


def _setter(p: NearDupParams):
    schema = pa.schema([("task", pa.int64()), ("cand", pa.int64()), ("blocks", pa.int64()), ("sig", pa.binary()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                sets = [shingle_set(x.as_buffer().to_pybytes(), p.words) for x in b["text"].cast(pa.binary())]
                yield pa.record_batch([b["task"], b["cand"], b["blocks"], b["sig"], pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


def link_group(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """(root of each set, links seen of each set) within one group: exactly the components of its links.

    A set is tried first against the set with most links so far; if that joins it to the only component
    there is, nothing else can change. Otherwise its intersections with all earlier sets are counted at
    once by an inverted index."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root, hits = list(range(n)), [0] * n
    index = None
    comps, hub = min(n, 1), 0

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(i: int, j: int) -> int:
        hits[i] += 1
        hits[j] += 1
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
        return int(i != j)

    for i in range(1, n):
        comps += 1
        inter = len(np.intersect1d(sets[hub], sets[i], assume_unique=True))
        if 100 * inter >= percent * (size[hub] + size[i] - inter):
            comps -= union(hub, i)
            if comps == 1:
                continue
        if n <= 8:
            inter = np.array([len(np.intersect1d(sets[j], sets[i], assume_unique=True)) for j in range(i)])
        else:
            if index is None:
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                values, starts = np.unique(flat[order], return_index=True)
                index = values, np.append(starts, len(flat)), np.repeat(np.arange(n), size)[order]
            values, starts, docs = index
            at = np.searchsorted(values, sets[i])
            lens = starts[at + 1] - starts[at]
            pos = np.repeat(starts[at] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            inter = np.bincount(docs[pos], minlength=n)[:i]
        for j in np.flatnonzero(100 * inter >= percent * (size[:i] + size[i] - inter)):
            comps -= union(int(j), i)
        if hits[i] > hits[hub]:
            hub = i
    return [find(i) for i in range(n)], hits


def _verifier(percent: int):
    """Rows of one task come together: (a, b) joins every class to its component's first; hub marks one class of each."""
    schema = pa.schema([("cand", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("hub", pa.bool_())])

    def solve(cand: int, sigs: dict[bytes, np.ndarray]) -> list[tuple]:
        names = list(sigs)
        roots, hits = link_group(list(sigs.values()), percent)
        best: dict[int, int] = {}
        for i, r in enumerate(roots):
            if r not in best or hits[i] > hits[best[r]]:
                best[r] = i
        return [(cand, names[r], names[i], best[r] == i) for i, r in enumerate(roots)]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, cand, sigs, out = None, None, {}, []
        for b in batches:
            for t, c, sig, items in zip(b["task"].to_pylist(), b["cand"].to_pylist(), b["sig"].to_pylist(), b["items"], strict=True):
                if t != task:
                    if sigs:
                        out += solve(cand, sigs)
                    task, cand, sigs = t, c, {}
                sigs[sig] = np.frombuffer(items.as_buffer().to_pybytes(), U64)
            if len(out) > 5000:
                yield batch(out)
                out = []
        if sigs:
            out += solve(cand, sigs)
        if out:
            yield batch(out)

    return run


LINKS = "cand long, a binary, b binary, hub boolean"


def _compare(sets: DataFrame, percent: int) -> DataFrame:
    """Verify (task, cand, sig, items): every pair within a task."""
    return sets.select("task", "cand", "sig", "items").repartition("task").sortWithinPartitions("task").mapInArrow(_verifier(percent), LINKS)


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: rk (hash of id and text), id, n (set size), sig (of its set, null if empty), component_id (least id)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).select(F.xxhash64("id", "text").alias("rk"), "id", "text")
    made = settle(rows.mapInArrow(_sketcher(p), "rk long, id long, n long, sig binary, nid long, bands array<long>"), "sketch")
    base = made.drop("bands")
    keys = settle(made.where("n > 0").groupBy("nid").agg(F.any_value("bands").alias("bands")), "bands").select("nid", F.explode("bands").alias("key"))
    multi = settle(keys.groupBy("key").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).where("lo < hi").select("key", "lo"), "buckets")
    cands = components(keys.join(multi, "key").where("nid <> lo").select(F.col("lo").alias("a"), F.col("nid").alias("b")), "cand")
    classes = base.where("n > 0").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.min("rk").alias("rk"), F.min("nid").alias("nid"), F.min("n").alias("n"))
    if cands is None:
        known = classes.where("size > 1").select("sig", F.col("least").alias("component_id"))
    else:
        classes = settle(classes, "classes")
        marked = _mark(classes, cands, p)
        links = _verify(rows, marked, p)
        roots = components(links.select("a", "b"), "links")
        if roots is None:
            known = classes.where("size > 1").select("sig", F.col("least").alias("component_id"))
        else:
            of = classes.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").where("size > 1 or root is not null")
            of = settle(of.withColumn("root", F.coalesce("root", "sig")), "of")
            least = settle(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"), F.sum("size").alias("rows")).where("rows > 1").drop("many", "rows"), "least")
            known = settle(salted_join(of.select("sig", "root"), least, ["root"], F.col("sig"), "inner").select("sig", "component_id"), "known")
    counted = salted_join(base, known, ["sig"], F.struct("rk", "id"))
    return counted.select("rk", "id", "n", "sig", F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id")).alias("component_id"))


def _mark(classes: DataFrame, cands: DataFrame, p: NearDupParams) -> DataFrame:
    """Classes of candidate groups, dealt to tasks: a group beyond `block` classes, or its shingles, is split by a hash."""
    met = settle(classes.select("sig", "rk", "nid", "n").join(cands.select(F.col("node").alias("nid"), F.col("root").alias("cand")), "nid"), "met")
    sizes = met.groupBy("cand").agg(F.count("*").alias("many"), F.sum("n").alias("total"))
    sizes = settle(sizes.where("many > 1").select("cand", F.greatest(F.ceil(F.col("many") / p.block), F.ceil(F.col("total") / p.block_shingles)).cast("long").alias("blocks")), "sizes")
    return settle(
        salted_join(met, sizes, ["cand"], F.col("sig"), "inner").select("sig", "rk", "cand", "blocks", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block")).withColumn("task", F.xxhash64("cand", "block")),
        "marked",
    )


def _verify(rows: DataFrame, marked: DataFrame, p: NearDupParams) -> DataFrame:
    """Links (a, b) that join exactly what the full sets' links join within each candidate group."""
    texts = rows.select("rk", "text").join(marked.hint("shuffle_hash"), "rk").select("task", "cand", "blocks", "sig", "text")
    sets = texts.mapInArrow(_setter(p), "task long, cand long, blocks long, sig binary, items binary")
    wide = marked.where("blocks > 1")
    if wide.isEmpty():
        return settle(_compare(sets, p.percent), "links")
    sets = settle(sets, "sets")
    links = settle(_compare(sets, p.percent), "links")
    # Groups of several blocks: the blocks' hubs meet first, as most of such a group is one component.
    sets = sets.where("blocks > 1")  # only these groups' sets move again
    big = settle(wide.select("sig", "cand", "block", "blocks"), "big")
    hubs = links.where("hub").join(big.select(F.col("sig").alias("b"), "blocks"), "b", "left_semi").select("cand", F.col("b").alias("sig")).distinct()
    many = settle(hubs.groupBy("cand").agg(F.ceil(F.count("*") / p.block).cast("long").alias("parts")), "hubs")
    met = salted_join(hubs, many, ["cand"], F.col("sig"), "inner").withColumn("task", F.xxhash64("cand", F.pmod(F.xxhash64("sig", F.lit(7)), "parts")))
    first = settle(_compare(met.select("task", "cand", "sig").join(sets.select("sig", "items"), "sig").select("task", "cand", "sig", "items"), p.percent), "hublinks")
    links = links.unionByName(first)
    roots = components(links.select("a", "b"), "links")
    if roots is None:
        return links
    label = settle(big.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "label")
    per = label.groupBy("cand", "root").agg(F.count("*").alias("many"))
    top = settle(per.groupBy("cand").agg(F.max_by("root", "many").alias("main"), F.count("*").alias("kinds")).where("kinds > 1"), "top")
    if top.isEmpty():
        return links
    # What is outside a group's main component meets every block of the group: exact, however many there are.
    left = settle(salted_join(label, top, ["cand"], F.col("sig"), "inner"), "left")
    stray = left.where("root <> main").select("cand", "sig", "blocks")
    count = stray.groupBy("cand").agg(F.ceil(F.count("*") / p.block).cast("long").alias("parts"))
    count = settle(count, "strays")
    own = salted_join(stray, count, ["cand"], F.col("sig"), "inner").withColumn("part", F.pmod(F.xxhash64("sig", F.lit(11)), "parts"))
    one = own.select("cand", "sig", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    two = salted_join(left.select("cand", "sig", "block"), count, ["cand"], F.col("sig"), "inner").select("cand", "sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block")
    met = one.unionByName(two).distinct().select(F.xxhash64("cand", "part", "block").alias("task"), "cand", "sig")
    return links.unionByName(settle(_compare(met.join(sets.select("sig", "items"), "sig").select("task", "cand", "sig", "items"), p.percent), "strays"))


def dedup(docs: DataFrame, p: NearDupParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row left of each component: that with its least id (of repeated ids the least hash of id and text)."""
    found = settle(near_duplicates(docs, p, id_col, text_col), "near")
    own = found.where("sig is null or id <=> component_id")
    # a component's kept row: one rk; with unique ids own has it already
    first = own.where("sig is not null").groupBy("component_id").agg(F.min("rk").alias("rk"), F.countDistinct("rk").alias("kinds"))
    lost = own.where("sig is not null").join(settle(first.where("kinds > 1"), "first").select("component_id", F.col("rk").alias("keep")), "component_id", "left")
    keep = own.where("sig is null").select("rk").unionByName(lost.where("keep is null or keep = rk").select("rk"))
    rk, times, row = (fresh(n, docs.columns) for n in ("_rk", "_times", "_row"))
    often = keep.groupBy(F.col("rk").alias(rk)).agg(F.count("*").alias(times))
    data = docs.withColumn(rk, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")))
    kept = data.join(often.hint("shuffle_hash"), rk)
    cols = [F.col(c) for c in docs.columns]
    once = kept.where(F.col(times) == 1).select(*docs.columns)
    same = kept.where(F.col(times) > 1).groupBy(rk).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias(row)).select(f"{row}.*")
    return once.unionByName(same)

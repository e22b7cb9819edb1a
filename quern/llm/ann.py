"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, by which the largest inner product
is the least distance. Centroids come from balanced bisecting k-means over a bounded sample and are searched
by beam search in an in-memory neighbour graph. A vector near a boundary is written to every list whose
centroid is within `spread` times its least distance, `replicas` at most; a query reads its `sure` nearest lists and those within `reach` times the distance of the last of these, `probes` at
most, and scores all they hold exactly. Queries that found fewer than k so read every list.

Equal vectors are one class, of which a search for k needs the k + 1 smallest ids only: copies never fill a
list. A list of more than `part_rows` classes is split by a hash into parts that different tasks score.

Cases: vectors that are null, empty, zero, hold null or non-finite components or have no id take no part, as
queries neither; vectors of different dimensions have no inner product, so each dimension is searched by
itself; repeated rows (same id and vector) count once; with fewer candidates than k all are returned; equal
scores go by id; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import salted_join, settle
from quern.ship import ship


@dataclass(frozen=True)
class AnnParams:
    """sample bounds the vectors that centroids are fitted on, lists the centroids (which every executor gets)."""

    sample: int = 20_000
    lists: int = 4096
    list_rows: int = 128
    part_rows: int = 4096
    rounds: int = 10
    degree: int = 24
    beam: int = 48
    replicas: int = 6
    spread: float = 1.15
    sure: int = 32
    probes: int = 128
    reach: float = 1.10
    seed: int = 5


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def balanced_centroids(x: np.ndarray, n: int, p: AnnParams) -> np.ndarray:
    """n centroids of equally large groups: groups are halved by 2-means, cut at the median of the distances' difference."""
    rng = np.random.default_rng(p.seed)
    out = []
    todo = [(np.arange(len(x)), n)]
    while todo:
        rows, lists = todo.pop()
        own = x[rows]
        if lists == 1:
            out.append(own.mean(axis=0))
            continue
        c = own[rng.choice(len(rows), 2, replace=False)]
        left = lists // 2
        cut = len(rows) * left // lists
        for _ in range(p.rounds):
            order = np.argpartition(own @ (c[1] - c[0]), cut)
            c = np.stack([own[order[:cut]].mean(axis=0), own[order[cut:]].mean(axis=0)])
        todo += [(rows[order[:cut]], left), (rows[order[cut:]], lists - left)]
    return np.array(out, np.float32)


class CentroidGraph:
    """Each centroid's nearest neighbours and a few far ones; searched for many vectors at a time."""

    def __init__(self, centroids: np.ndarray, p: AnnParams):
        self.c, self.p = centroids, p
        n = len(centroids)
        rng = np.random.default_rng(p.seed)
        near = min(p.degree, n - 1)
        links = np.empty((n, near), np.int32)
        for at in range(0, n, 1024):
            d = _square(centroids[at : at + 1024], centroids)
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            links[at : at + 1024] = np.argpartition(d, near - 1, axis=1)[:, :near] if near else links[at : at + 1024]
        self.links = np.concatenate([links, rng.integers(0, n, (n, 4), dtype=np.int32)], axis=1)
        self.entry = rng.choice(n, min(n, 32), replace=False)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), nearest first, by beam search."""
        n, m = len(self.c), len(q)
        beam = min(n, max(self.p.beam, k + k // 4))
        k = min(k, n)
        q = q.astype(np.float32)
        norm, qn = (self.c * self.c).sum(1), (q * q).sum(1)
        dist = lambda rows, ids: np.maximum(0, qn[rows][:, None] + norm[ids] - 2 * np.einsum("ij,ikj->ik", q[rows], self.c[ids]))
        seen = np.zeros((m, n), bool)
        first = np.broadcast_to(self.entry, (m, len(self.entry)))
        ids = np.full((m, beam), -1, np.int64)
        d = np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        all_rows = np.arange(m)

        def push(rows: np.ndarray, new: np.ndarray, nd: np.ndarray) -> None:
            i = np.concatenate([ids[rows], new], axis=1)
            x = np.concatenate([d[rows], nd], axis=1)
            f = np.concatenate([done[rows], ~np.isfinite(nd)], axis=1)
            top = np.argsort(x, axis=1, kind="stable")[:, :beam]
            ids[rows], d[rows], done[rows] = np.take_along_axis(i, top, 1), np.take_along_axis(x, top, 1), np.take_along_axis(f, top, 1)

        seen[all_rows[:, None], first] = True
        push(all_rows, first, dist(all_rows, first))
        wide = 4  # nodes expanded at a time
        while True:
            rows = np.flatnonzero((~done).any(1))
            if not len(rows):
                break
            pick = np.argsort(done[rows], axis=1, kind="stable")[:, :wide]
            open_ = ~np.take_along_axis(done[rows], pick, 1)
            node = np.where(open_, np.take_along_axis(ids[rows], pick, 1), 0)
            done[rows[:, None], pick] = True
            new = self.links[node].reshape(len(rows), -1).astype(np.int64)
            nd = dist(rows, new)
            nd[np.repeat(~open_, self.links.shape[1], axis=1)] = np.inf
            nd[seen[rows[:, None], new]] = np.inf
            order = np.argsort(new, axis=1, kind="stable")
            twin = np.zeros_like(nd, bool)
            s = np.take_along_axis(new, order, 1)
            fine = np.isfinite(np.take_along_axis(nd, order, 1))
            same = (s[:, 1:] == s[:, :-1]) & fine[:, :-1]
            np.put_along_axis(twin, order[:, 1:], same, 1)
            nd[twin] = np.inf
            r, col = np.nonzero(np.isfinite(nd))
            seen[rows[r], new[r, col]] = True
            push(rows, new, nd)
        return ids[:, :k], d[:, :k]


@dataclass
class AnnModel:
    params: AnnParams
    dim: int
    top: float  # largest squared norm
    graph: CentroidGraph

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.top - (x.astype(np.float64) ** 2).sum(1)))[:, None]], axis=1).astype(np.float32)

    def lists(self, x: np.ndarray, most: int, ratio: float, sure: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: a row's `sure` nearest lists and those within ratio times the last one's distance."""
        rows, found = [], []
        step = max(1, min(2048, 64_000_000 // max(1, len(self.graph.c))))
        for at in range(0, len(x), step):
            ids, d = self.graph.search(x[at : at + step], most)
            at_least = min(sure, d.shape[1])
            ok = (d <= d[:, at_least - 1 : at_least] * ratio * ratio + 1e-12) & (ids >= 0)
            r, c = np.nonzero(ok)
            rows.append(r + at)
            found.append(ids[r, c])
        return np.concatenate(rows), np.concatenate(found)


def usable(vector: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def fit(classes: DataFrame, dim: int, n: int, top: float, p: AnnParams) -> AnnModel:
    """Centroids and their graph from at most p.sample classes, the least by hash of their vectors."""
    rows = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(p.sample).toArrow()
    x = _matrix(rows["vec"].combine_chunks(), dim)
    model = AnnModel(p, dim, top, None)
    lifted = model.lift(x)
    lists = max(1, min(p.lists, len(x) // 4, -(-n // p.list_rows)))
    model.graph = CentroidGraph(balanced_centroids(lifted, lists, p), p)
    return model


def search(vectors: DataFrame, is_query: Column, k: int, p: AnnParams = AnnParams(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): of each query row the k nearest found, its own id left out."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vec"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    dims = sorted(r["dim"] for r in rows.select(F.size("vec").alias("dim")).distinct().collect())  # one, but for mixed tables
    found = None
    for dim in dims:
        one = _search(rows.where(F.size("vec") == dim), dim, kind, k, p, key)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double") if found is None else found


def _search(rows: DataFrame, dim: int, kind: str, k: int, p: AnnParams, key: str) -> DataFrame:
    """search() over usable rows (id, vec, q) of one dimension."""
    spark = rows.sparkSession
    zero = F.lit(0.0).cast(kind)  # -0 becomes 0
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + zero))
    first = Window.partitionBy("vec").orderBy("id")
    few = rows.select("id", "vec").withColumn("at", F.dense_rank().over(first)).where(F.col("at") <= k + 1)
    classes = few.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("cls", F.monotonically_increasing_id())
    classes = settle(classes, "classes")
    asked = settle(rows.where("q").select("id", "vec").distinct().join(classes.select("vec", "cls"), "vec").select("id", "cls"), "asked")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, top, ids = classes.agg(F.count("*"), F.max(square), F.sum(F.size("ids"))).first()
    fitted = fit(classes, dim, n, float(top), p)
    model = spark.sparkContext.broadcast(fitted)
    index = settle(classes.select("cls", "vec", "ids").mapInArrow(_poster(model), f"list long, cls long, vec array<{kind}>, ids array<long>"), "postings")
    parts = settle(index.groupBy("list").agg(F.ceil(F.count("*") / p.part_rows).cast("long").alias("parts")), "lists")
    held = index.join(F.broadcast(parts), "list").select(F.xxhash64("list", F.pmod(F.xxhash64("cls"), "parts")).alias("part"), F.lit(0).alias("kind"), "cls", "vec", "ids")

    def nearest(queries: DataFrame, every: bool) -> DataFrame:
        probes = queries.mapInArrow(_prober(model, every), f"list long, cls long, vec array<{kind}>").join(F.broadcast(parts), "list")
        probes = probes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        probes = probes.select(F.xxhash64("list", "i").alias("part"), F.lit(1).alias("kind"), "cls", "vec", F.array().cast("array<long>").alias("ids"))
        both = held.unionByName(probes).repartition("part").sortWithinPartitions("part", "kind")
        near = both.mapInArrow(_scorer(dim, k + 1), "cls long, ids array<long>, scores array<double>")
        return settle(near.repartition("cls").sortWithinPartitions("cls").mapInArrow(_merger(k + 1), "cls long, ids array<long>, scores array<double>"), "best")

    queries = asked.select("cls").distinct().join(classes.select("cls", "vec"), "cls")
    best = nearest(queries, False)
    enough = best.where(F.size("ids") >= min(k + 1, ids))
    short = settle(queries.join(enough, "cls", "left_anti"), "short")
    if not short.isEmpty():
        best = enough.unionByName(nearest(short, True))
    hits = salted_join(asked, best, ["cls"], F.col("id"), "inner")
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("id"))
    out = hits.select(F.col("id").alias("query_id"), F.posexplode(F.slice(pairs, 1, k)).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.ids").alias(key), F.col("hit.scores").alias("score"))


def _poster(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if len(b):
                row, lists = m.lists(m.lift(_matrix(b["vec"], m.dim)), m.params.replicas, m.params.spread)
                got = b.take(pa.array(row))
                yield pa.record_batch([pa.array(lists, pa.int64()), got["cls"], got["vec"], got["ids"]], names=["list", "cls", "vec", "ids"])

    return run


def _prober(model, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if len(b):
                x = _matrix(b["vec"], m.dim)
                # a query's length doesn't change its order: it is searched at the vectors' largest norm
                unit = x * (np.sqrt(m.top) / np.sqrt((x * x).sum(1)))[:, None]
                lifted = np.concatenate([unit, np.zeros((len(x), 1))], axis=1).astype(np.float32)
                if every:
                    row, lists = (v.ravel() for v in np.indices((len(x), len(m.graph.c))))
                else:
                    row, lists = m.lists(lifted, m.params.probes, m.params.reach, m.params.sure)
                got = b.take(pa.array(row))
                yield pa.record_batch([pa.array(lists, pa.int64()), got["cls"], got["vec"]], names=["list", "cls", "vec"])

    return run


def _ranked(ids: list[int], scores: list[float], k: int) -> tuple[list[int], list[float]]:
    best = {}
    for s, i in sorted(zip((-x for x in scores), ids, strict=True)):
        if i not in best:
            best[i] = -s
            if len(best) == k:
                break
    return list(best), list(best.values())


def _scorer(dim: int, k: int):
    """Rows of a part come together, its vectors before its queries: every query's k nearest of the part."""
    schema = pa.schema([("cls", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def score(x: np.ndarray, ids: list[list[int]], least: np.ndarray, q: np.ndarray, cls: list[int]) -> list[tuple]:
        s = q @ x.T
        take = min(len(x), k)
        out = []
        last = -np.partition(-s, take - 1, axis=1)[:, take - 1]
        # all that may tie with the last one, however many: what rounding can move stays inside the margin
        margin = 1e-14 * (dim + 8) * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max())
        for i, c in enumerate(cls):
            near = np.flatnonzero(s[i] >= last[i] - margin[i])
            # one product at a time, so that a pair's score never depends on its neighbours
            exact = (x[near] * q[i]).sum(axis=1)
            order = np.lexsort((least[near], -exact))[:k]
            got = [(int(v), float(exact[j])) for j in order for v in ids[near[j]]]
            out.append((c, *_ranked([v for v, _ in got], [y for _, y in got], k)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, xs, ids, x, least = None, [], [], None, None
        for b in batches:
            if not len(b):
                continue
            at = b["part"].to_numpy()
            kind = b["kind"].to_numpy()
            edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                if at[lo] != part:
                    part, xs, ids, x = at[lo], [], [], None
                own = b.slice(lo, hi - lo)
                m = _matrix(own["vec"], dim)
                if kind[lo] == 0:
                    xs.append(m)
                    ids += own["ids"].to_pylist()
                    continue
                if not xs:
                    continue
                if x is None:
                    x, least = np.concatenate(xs), np.array([v[0] for v in ids])
                cls = own["cls"].to_pylist()
                for i in range(0, len(m), 512):
                    out = score(x, ids, least, m[i : i + 512], cls[i : i + 512])
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _merger(k: int):
    schema = pa.schema([("cls", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, ids, scores, out = None, [], [], []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for c, i, s in zip(b["cls"].to_pylist(), b["ids"].to_pylist(), b["scores"].to_pylist(), strict=True):
                if c != cls:
                    if ids:
                        out.append((cls, *_ranked(ids, scores, k)))
                    cls, ids, scores = c, [], []
                ids, scores = _ranked(ids + i, scores + s, k)
            if len(out) > 2000:
                yield batch()
                out = []
        if ids:
            out.append((cls, *_ranked(ids, scores, k)))
        if out:
            yield batch()

    return run

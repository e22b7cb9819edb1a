"""Quality classifier on supervised subword embeddings.

A document is a bag of features: its words, and of every word with its ends marked the character n-grams. A word
that repeats the one before it is read as the word AGAIN (as tokenizers with a repeat token do), whose vectors
are learned like any other's. Each feature is hashed to one of `rows` learned vectors. The mean of a document's
vectors goes through a softmax over the two labels. Vectors and output weights are trained together by stochastic gradient descent in
numpy, in one task, from a bounded sample of labelled rows taken by least hash of their ids, so that reruns
agree.

Scoring needs (w1 - w0) . vector of every hashed feature only: one float for each of the `rows`, which is
what executors get (1 MB at the default, whatever the corpus). A word's sum and number of features are kept
in a bounded table, so that a text costs one lookup a word.

Cases: null and blank texts have no feature and get the score of the bias; repeated ids score alike; with
no labels of one of the two kinds every score is 0.5 + epsilon's side of the known kind (all 1 or all 0; 0.5
without any label); labels without a text or with a null label, and ids that have both labels, are left out; of
rows that repeat a labelled id the least text is learned from; texts of any length are learned from; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice, pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.ship import ship

MEMO_WORDS = 300_000
#: What a word that repeats the one before it is read as: no text holds it, as it has white space.
AGAIN = b" again"


@dataclass(frozen=True)
class QualityParams:
    """sample bounds the number of labelled rows that are learned from (half of them from either label)."""

    rows: int = 1 << 18
    dim: int = 16
    low: int = 2
    high: int = 4
    epochs: int = 6
    rate: float = 0.1
    batch: int = 16
    sample: int = 4000
    seed: int = 11


def features(word: bytes, p: QualityParams) -> list[int]:
    """Hashed rows of a word and its character n-grams (of bytes; ends marked)."""
    w = b"<" + word + b">"
    out = [zlib.crc32(w) % p.rows]
    for n in range(p.low, p.high + 1):
        out += [zlib.crc32(w[i : i + n], n) % p.rows for i in range(len(w) - n + 1)]
    return out


def read_words(text: bytes | None) -> list[bytes]:
    """Words between white space; AGAIN for each that equals the one before it in the text."""
    words = text.split() if text else []
    if any(map(eq, words, islice(words, 1, None))):
        return words[:1] + [AGAIN if a == b else b for a, b in pairwise(words)]
    return words


@dataclass
class QualityModel:
    """What scoring needs of a trained model."""

    params: QualityParams
    gain: np.ndarray  # (w1 - w0) . vector of each row
    bias: float
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"params": self.params, "gain": self.gain, "bias": self.bias, "memo": {}}

    def score(self, text: bytes | None) -> float:
        total, count, memo = 0.0, 0, self.memo
        for w in read_words(text):
            got = memo.get(w)
            if got is None:
                f = features(w, self.params)
                got = float(self.gain[f].sum(dtype=np.float64)), len(f)
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                memo[w] = got
            total += got[0]
            count += got[1]
        z = self.bias + (total / count if count else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[bytes], labels: list[int], p: QualityParams) -> QualityModel:
    """Mini-batch SGD with a falling rate; the two labels weigh alike."""
    rng = np.random.default_rng(p.seed)
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return QualityModel(p, np.zeros(p.rows, np.float32), 0.0 if not labels else 30.0 if labels[0] else -30.0)
    memo: dict[bytes, np.ndarray] = {}
    bags = [bag(t, p, memo) for t in texts]
    emb = rng.uniform(-1 / p.dim, 1 / p.dim, (p.rows, p.dim)).astype(np.float32)
    out = np.zeros((2, p.dim), np.float32)
    bias = np.zeros(2, np.float32)
    weight = (len(y) / (2 * np.bincount(y, minlength=2))).astype(np.float32)
    steps, done = p.epochs * len(y), 0
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), p.batch):
            pick = order[at : at + p.batch]
            step(emb, out, bias, [bags[i] for i in pick], y[pick], weight[y[pick]], p.rate * (1 - done / steps))
            done += len(pick)
    gain = emb @ (out[1] - out[0])
    if not np.isfinite(gain).all():
        raise ArithmeticError("training diverged: choose a lower rate")
    return QualityModel(p, gain, float(bias[1] - bias[0]))


def bag(text: bytes, p: QualityParams, memo: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, their shares of the text's features)."""
    parts = [np.empty(0, np.int32)]
    for w in read_words(text):
        if w not in memo:
            memo[w] = np.array(features(w, p), np.int32)
        parts.append(memo[w])
    rows, counts = np.unique(np.concatenate(parts), return_counts=True)
    return rows, (counts / max(1, counts.sum())).astype(np.float32)


def step(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One step of gradient descent on the weighted cross-entropy of a batch, in place.

    The gradient of a document's mean vector is cut to length 1. Of a vector it takes the square root of its share,
    times the dimension, instead of the share itself, so that rare rows learn; the bias moves at a tenth of the rate."""
    hidden = np.stack([share @ emb[rows] for rows, share in bags])
    z = np.clip(hidden @ out.T + bias, -20, 20)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    err = z / z.sum(axis=1, keepdims=True)
    err[np.arange(len(y)), y] -= 1
    err *= weight[:, None]
    back = err @ out
    back /= np.maximum(1, np.linalg.norm(back, axis=1, keepdims=True))
    out -= rate * err.T @ hidden
    bias -= rate * 0.1 * err.sum(axis=0)
    for (rows, share), g in zip(bags, back, strict=True):
        emb[rows] -= (rate * emb.shape[1]) * np.outer(np.sqrt(share), g)


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(key.cast("long").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Learn from at most p.sample labelled rows, the least by hash of each label, none of them held out."""
    ship(docs.sparkSession)
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where(F.col("y") == F.col("_most")).drop("_most")
    half = p.sample // 2
    picks = [known.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(half) for v in (0, 1)]
    few = F.broadcast(picks[0].unionByName(picks[1]))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null").join(few, "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))  # so that repeated ids bring no more rows than labels
    # one task learns from the bounded sample, so that the driver holds the finished table alone
    made = rows.repartition(1).mapInArrow(_trainer(p), "gain binary, bias double").collect()
    return QualityModel(p, np.frombuffer(bytes(made[0]["gain"]), np.float32), made[0]["bias"]) if made else train([], [], p)


def _trainer(p: QualityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({row for b in batches for row in zip(b["id"].to_pylist(), b["y"].to_pylist(), b["text"].to_pylist(), strict=True)})
        model = train([t.encode() for _, _, t in got], [y for _, y, _ in got], p)
        yield pa.record_batch([pa.array([model.gain.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["gain", "bias"])

    return run


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(key, pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b["text"].cast(pa.binary())
            yield pa.record_batch([b["id"], b["held_out"], pa.array([m.score(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts], pa.float64())], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), held_out(F.col(key)).alias("held_out"))
    return rows.mapInArrow(run, f"{key} long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs whose text scores `least` or more, with docs' columns: one pass over the rows, no shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ok = [m.score(t.as_buffer().to_pybytes() if t.is_valid else None) >= least for t in b.column(at).cast(pa.binary())]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

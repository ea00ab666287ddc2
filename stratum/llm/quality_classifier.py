"""Quality classifier on random-indexing word vectors.

Words hash to 2**BITS buckets. Each bucket has a fixed sparse random index vector; its
context vector is the sum of the index vectors of the words within WINDOW places of its
words, over the whole corpus. A document's vector is the mean of its words' normalised
context vectors, weighted against common words by a / (a + frequency). A two-layer
network in numpy maps it to a logit; a temperature chosen on held-out labelled rows
calibrates the probability.

Context vectors are accumulated per input partition into one matrix of fixed size, of
which the row blocks that have words are added up in a tree of groups of FAN; the sum (a
few MB, whatever the corpus) goes to the driver and back. The network is fitted on at most `max_labelled` labelled
documents (the bound is a parameter); counts and vectors cover every document.

Defined results: null, empty and blank texts have the zero vector. Texts are read whole.
Without labelled rows, or with one class only, every probability is that class's share
(0.5 without labels). Rows with a null doc_id are scored like others but are never
fitted on. Repeated rows are scored each; an empty table gives an empty
table. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import mapped, ship
from ._labelled import sample as labelled

BITS = 15
WIDTH = 64
NONZERO = 2
WINDOW = 2
ROWS = 1024
FAN = 64
COMMON = 1e-3
MAX_LABELLED = 8000
SLICE = 1 << 20


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    seed = np.arange(1 << BITS, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64)
    x = T.mix(seed + np.uint64(0x1234567))
    return (x % np.uint64(WIDTH)).astype(np.int64), np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = T.buffers(column)
    starts, ends, owner = T.words(raw, offsets)
    return (T.span_hashes(raw, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), owner


def accumulate(columns: Iterator[pa.Array]) -> np.ndarray:
    """Context vectors, and in the last column the number of words, of every bucket."""
    place, sign = index_vectors()
    out = np.zeros((1 << BITS, WIDTH + 1), np.int64)
    flat = np.zeros((1 << BITS) * WIDTH)
    for column in columns:
        word, owner = buckets(column)
        out[:, WIDTH] += np.bincount(word, minlength=1 << BITS)
        for o in range(1, WINDOW + 1):
            same = owner[o:] == owner[:-o] if len(owner) > o else np.zeros(0, bool)
            left, right = word[:-o][same], word[o:][same]
            for a, b in ((left, right), (right, left)):
                for j in range(NONZERO):
                    flat += np.bincount(a * WIDTH + place[b, j], weights=sign[b, j], minlength=len(flat))
    out[:, :WIDTH] = flat.reshape(-1, WIDTH)
    return out


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = accumulate(b.column(0).slice(x, y - x) for b in batches for x, y in T.slices(b.column(0), 4 * SLICE))
    part = TaskContext.get().partitionId()
    for k in range(0, 1 << BITS, ROWS):
        rows = total[k : k + ROWS]
        if rows[:, WIDTH].any():  # buckets without a word have no context either
            yield pa.record_batch([pa.array([k]), pa.array([part]), pa.array([rows.astype(np.int32 if np.abs(rows).max() < 2**30 else np.int64).tobytes()])], ["first", "part", "sums"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(ROWS * (WIDTH + 1), np.int64)
    for x in table.column("sums"):
        data = x.as_buffer()
        total += np.frombuffer(data, np.int32 if len(data) == total.size * 4 else np.int64)
    return pa.table({"first": [table.column("first")[0].as_py()], "part": [table.column("part")[0].as_py()], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One weighted float32 vector a bucket, from the whole corpus."""
    schema = "first long, part long, sums binary"
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    parts = mapped(text, _partials, schema)
    # groups of about FAN matrices are added, then groups of FAN sums, until one is left
    left = (docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    added = parts
    while left > 1:
        left = -(-left // FAN)
        added = added.withColumn("part", F.col("part") % left).groupBy("first", "part").applyInArrow(_add, schema)
    out = np.zeros((1 << BITS, WIDTH + 1))
    for row in added.collect():
        out[row.first : row.first + ROWS] += np.frombuffer(row.sums, np.int64 if len(row.sums) == ROWS * (WIDTH + 1) * 8 else np.int32).reshape(ROWS, -1)
    share = out[:, WIDTH] / max(out[:, WIDTH].sum(), 1)
    norm = np.linalg.norm(out[:, :WIDTH], axis=1)
    return (out[:, :WIDTH] / np.maximum(norm, 1)[:, None] * (COMMON / (COMMON + share))[:, None]).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of every text."""
    word, owner = buckets(column)
    out = np.zeros((len(column), vectors.shape[1]), np.float32)
    for low in range(0, len(word), 1 << 16):
        own = owner[low : low + (1 << 16)]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(vectors[word[low : low + (1 << 16)]], first, axis=0)
    return out / np.maximum(np.bincount(owner, minlength=len(column)), 1)[:, None]


class Network:
    """Two layers, tanh between them, and a temperature."""

    def __init__(self, width: int, hidden: int = 32, seed: int = 0):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 1 / math.sqrt(width), (width, hidden)), np.zeros(hidden), r.normal(0, 1 / math.sqrt(hidden), (hidden, 1)), np.zeros(1)]
        self.mean, self.scale, self.temperature, self.constant = np.zeros(width), np.ones(width), 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> Network:
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        held, train = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            r.shuffle(train)
            for at in range(0, len(train), 128):
                xs, ys = (x[train[at : at + 128]] - self.mean) / self.scale, y[train[at : at + 128]]
                hidden = np.tanh(xs @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip((hidden @ self.w[2] + self.w[3])[:, 0], -60, 60)))
                off = ((p - ys) / len(ys))[:, None]
                back = off @ self.w[2].T * (1 - hidden**2)
                grads = [xs.T @ back + decay * self.w[0], back.sum(axis=0), hidden.T @ off + decay * self.w[2], off.sum(axis=0)]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if len(held):
            z, t = self.logits(x[held]), y[held]
            loss = lambda temp: np.mean(np.logaddexp(0, z / temp) - t * z / temp)
            self.temperature = float(min(np.geomspace(0.25, 8, 200), key=loss))
        return self


def _examples(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.slices(batch.column(1), SLICE):
                x = pooled(batch.column(1).slice(a, b - a), vectors.value).astype(np.float32)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    return run


def _scores(vectors, network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.slices(batch.column(1), SLICE):
                p = network.probability(pooled(batch.column(1).slice(a, b - a), vectors.value))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "probability", "keep"])

    return run


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, probability of good quality, and keep (probability at least 0.5), of every row."""
    spark = docs.sparkSession
    ship(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = labelled(docs, labels, most).select("doc_id", "text", "quality")
    rows = sorted(mapped(chosen, _examples(vectors), f"doc_id {kind}, quality int, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), WIDTH)
    network = Network(WIDTH).fit(x, np.array([r.quality for r in rows], float))
    return mapped(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _scores(vectors, network), f"doc_id {kind}, probability double, keep boolean")

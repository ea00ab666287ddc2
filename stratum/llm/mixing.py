"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table predicts, for every document, a posterior
over domains (clean, low, toxic). Projected-gradient least squares then fits a rate
for every document: the expected tokens of domain k, sum(n_d * rate_d * p_dk), should
equal the target. In the metric that weighs a document by its tokens the gradient of a
document's rate is p_d . residual, so a step is rate <- clip(rate - p_d . step), with
step the residual scaled by the inverse Gram matrix of the documents that can follow it.
An iteration is two aggregates of a few numbers over the written table of posteriors; rates
are recomputed from the list of steps, so nothing per document is rewritten.

Features are the presence of words and of their first PREFIX bytes (case folded, signs
apart), hashed into 2**BITS buckets; so a telling word counts as much in a long document
as in a short one. The classifier is a softmax regression on the buckets whose share of
documents differs between a class and the rest by a z score of at least TELLING. As a
short text holds few of them, whatever its domain, the biases are fitted for each shape:
LENGTHS powers of two of the number of words by DISTINCT steps of the share of distinct
buckets; a shape without labelled rows has the biases of all. It is fitted on at most
`most` labelled documents (the bound is a parameter); everything else covers every
document. solve() ends when totals are within `close` of the targets, when a step gains
less than a ten-thousandth of the error, or after `most_steps` steps (a parameter); it
returns what was reached beside what was wanted, whichever ended it.

Defined results: null and empty texts have no tokens, the posterior of a text without
words, and add nothing to any total. Without labelled rows every posterior is uniform.
Repeated rows are documents each. Targets that can't be met are met as nearly as least
squares allows. An empty table gives an empty table. sample() keeps a row if a hash of
doc_id and text, as a number in [0, 1), is below its rate; it never repeats rows, so
rates above 1 act as 1 there. Rows are told apart by the SHA-256 of doc_id and text.
Other columns take no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import fresh, identity, mapped, materialise, sized
from ._labelled import sample as labelled

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}
BITS, PREFIX, TELLING = 18, 6, 5.0
LENGTHS, DISTINCT = 11, 6
MAX_LABELLED = 6000


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every word and prefix, repeated as they come, and the number of white-space separated words of each text."""
    raw, offsets = T.buffers(column)
    counts = np.bincount(T.words(raw, offsets)[2], minlength=len(column))
    raw = T.FOLD[raw]
    starts, ends, owner = T.words(raw, offsets)
    whole, part = T.span_hashes(raw, starts, ends), T.mix(T.span_hashes(raw, starts, np.minimum(ends, starts + PREFIX)))
    return (np.r_[whole, part] >> np.uint64(64 - BITS)).astype(np.int64), np.r_[owner, owner], counts


def shape(counts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The shape of texts by their numbers of words and of distinct buckets."""
    length = np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), LENGTHS - 1)
    return length * DISTINCT + np.minimum(distinct * DISTINCT // np.maximum(2 * counts, 1), DISTINCT - 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch.column(1)):
            bucket, owner, counts = features(batch.column(1).slice(a, b - a))
            key = np.unique(owner << BITS | bucket)
            at = np.searchsorted(key, np.arange(b - a + 1) << BITS)
            found = (key & ((1 << BITS) - 1)).astype(np.uint32)
            lists = [found[low:high].tobytes() for low, high in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a), pa.array(lists, pa.binary()), pa.array(shape(counts, np.diff(at)).astype(np.int32))], ["quality", "toxic", "words", "shape"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(lists: list[np.ndarray], shapes: np.ndarray, classes: np.ndarray, k: int, epochs: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets, k), most of them 0, and biases (shapes, k) of a softmax regression, by full-batch Adam."""
    n, sizes = len(lists), np.bincount(classes, minlength=k)
    flat = np.concatenate(lists).astype(np.int64) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    total = np.bincount(flat, minlength=1 << BITS)
    telling = np.zeros(1 << BITS, bool)
    for j in range(k):
        if 0 < sizes[j] < n:
            own = np.bincount(flat[classes[row] == j], minlength=1 << BITS)
            share = total / n
            z = (own / sizes[j] - (total - own) / (n - sizes[j])) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / sizes[j] + 1 / (n - sizes[j])))
            telling |= (np.abs(z) >= TELLING) & (total >= 3)
    used = np.flatnonzero(telling)
    some = telling[flat]
    row, place = row[some], np.searchsorted(used, flat[some])
    want = np.eye(k)[classes]
    prior = np.log(sizes + 1.0) - np.log(n + k)
    w, b = np.zeros((len(used), k)), np.tile(prior, (LENGTHS * DISTINCT, 1))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, epochs + 1):
        scores = np.stack([np.bincount(row, weights=w[place, j], minlength=n) for j in range(k)], axis=1) + b[shapes]
        off = (_softmax(scores) - want) / max(n, 1)
        grad = np.stack([np.bincount(place, weights=off[row, j], minlength=len(used)) for j in range(k)], axis=1) + decay * w
        gb = np.stack([np.bincount(shapes, weights=off[:, j], minlength=len(b)) for j in range(k)], axis=1) + decay * (b - prior)
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros((1 << BITS, k), np.float32)
    weights[used] = w
    return weights, b.astype(np.float32)


def predict(column: pa.Array, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (texts, k) and word counts."""
    bucket, owner, counts = features(column)
    key = np.unique(owner << BITS | bucket)
    bucket, owner = key & ((1 << BITS) - 1), key >> BITS
    shapes = shape(counts, np.bincount(owner, minlength=len(column)))
    some = (weights != 0).any(axis=1)[bucket]
    bucket, owner = bucket[some], owner[some]
    scores = np.stack([np.bincount(owner, weights=weights[bucket, j], minlength=len(column)) for j in range(weights.shape[1])], axis=1)
    return _softmax(scores + bias[shapes]), counts


def domain(quality: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    return np.where(toxic == 1, 2, np.where(quality == 0, 1, 0))


def model(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray] | None:
    rows = mapped(labelled(docs, labels, most).select("doc_id", "text", "quality", "toxic"), _rows, "quality int, toxic int, words binary, shape int")
    rows = sorted(rows.collect(), key=lambda r: (r.words, r.shape, r.quality, r.toxic))
    if not rows:
        return None
    classes = domain(np.array([r.quality for r in rows]), np.array([r.toxic for r in rows]))
    return fit([np.frombuffer(r.words, np.uint32) for r in rows], np.array([r.shape for r in rows]), classes, len(DOMAINS))


def _posterior(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = fitted.value if fitted else (np.zeros((1 << BITS, len(DOMAINS)), np.float32), np.zeros((LENGTHS * DISTINCT, len(DOMAINS)), np.float32))
        for batch in batches:
            for a, b in T.slices(batch.column(2)):
                p, counts = predict(batch.column(2).slice(a, b - a), weights, bias)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts.astype(np.int64)), *(pa.array(p[:, j]) for j in range(len(DOMAINS)))], ["doc_id", "row_key", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    return run


def posteriors(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, row_key, n_tokens and a posterior for each domain, of every row; written once."""
    fitted = model(docs, labels, most)
    fitted = docs.sparkSession.sparkContext.broadcast(fitted) if fitted else None
    rows = docs.select("doc_id", identity().alias("row_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = mapped(rows, _posterior(fitted), f"doc_id {kind}, row_key binary, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))
    return materialise(out, "posteriors")


def _rate(steps: list[np.ndarray], cap: float):
    """The rate after all steps: a fold of clipped updates from 1."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    if not steps:
        return F.lit(1.0)
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    moved = lambda acc, s: acc + sum((p[j] * s[j] for j in range(1, len(p))), p[0] * s[0])
    return F.aggregate(rows, F.lit(1.0), lambda acc, s: F.least(F.greatest(moved(acc, s), F.lit(0.0)), F.lit(float(cap))))


def solve(table: DataFrame, targets: dict[str, float], total: float | None = None, cap: float = 4.0, most_steps: int = 40, close: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps, reached totals and wanted totals.

    total: the tokens of the mixture; if None, as many as the domain of most weight has
    without repetition, so that none of it need go. A step that doesn't lower the error
    is quartered, at last replaced by the plain gradient's; steps end when they no longer
    lower the error by a ten-thousandth.
    """
    k, p = len(DOMAINS), [F.col(f"p_{d}") for d in DOMAINS]
    weights = np.array([targets[d] for d in DOMAINS], float)
    weights = weights / weights.sum()
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def totals(steps: list[np.ndarray]) -> np.ndarray:
        row = table.withColumn("rate", _rate(steps, cap)).agg(*(F.sum(n * F.col("rate") * x) for x in p)).first()
        return np.array([x or 0.0 for x in row])

    def gram(steps: list[np.ndarray], off: np.ndarray) -> np.ndarray:
        """Over documents whose rate can follow the residual: those inside, and those at a bound that it moves inside."""
        push = sum((p[j] * float(off[j]) for j in range(1, k)), p[0] * float(off[0]))
        rate = F.col("rate")
        free = ((rate > 0) & (rate < cap)) | ((rate <= 0) & (push > 0)) | ((rate >= cap) & (push < 0))
        row = table.withColumn("rate", _rate(steps, cap)).where(free).agg(*(F.sum(n * p[i] * p[j]) for i, j in pairs)).first()
        out = np.zeros((k, k))
        for (i, j), x in zip(pairs, row, strict=True):
            out[i, j] = out[j, i] = x or 0.0
        return out

    got = totals([])
    if total is None:
        total = got[weights.argmax()] / weights.max()
    want = weights * total
    steps: list[np.ndarray] = []
    size, gain, square = 1.0, 1.0, gram([], want - got)
    while len(steps) < most_steps and np.abs(got - want).max() > close * max(total, 1.0) and gain > 1e-4 and square.any():
        if size > 1e-2:
            step = size * np.linalg.solve(square + 1e-6 * max(np.trace(square), 1.0) * np.eye(k), want - got)
        else:  # the plain gradient always lowers the error
            step, gain = (want - got) / np.linalg.eigvalsh(square).max(), 0.0
        new = totals([*steps, step])
        old_error, new_error = ((got - want) ** 2).sum(), ((new - want) ** 2).sum()
        if new_error < old_error * (1 - 1e-9):
            gain = 1 - new_error / old_error
            steps, got, size = [*steps, step], new, min(1.0, size * 2) if size > 1e-2 else 1.0
            square = gram(steps, want - got)
        else:
            size /= 4
    return steps, got, want


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, cap: float = 4.0, total: float | None = None, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, row_key, n_tokens, posteriors and `rate` of every row."""
    table = posteriors(docs, labels, most)
    steps, _, _ = solve(table, targets or TARGETS, total, cap)
    return table.withColumn("rate", _rate(steps, cap))


def sample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, seed: int = 0, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that their rates keep, with the columns of docs."""
    rated = rates(docs, labels, targets, 1.0, None, most)
    draw = F.shiftrightunsigned(F.xxhash64("row_key", F.lit(seed)), 11).cast("double") / float(1 << 53)
    (key,) = fresh(docs, "__key")
    away = materialise(rated.where(draw >= F.col("rate")).select(F.col("row_key").alias(key)).distinct(), "left-out")
    return docs.withColumn(key, identity()).join(sized(away), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

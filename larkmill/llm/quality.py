"""Quality scores from attention-based multiple-instance learning.

A document is a bag of passages (stretches of about 64 words). Every passage is encoded:
hashed byte-trigram frequencies and a few surface statistics, standardized, go through a
small ReLU layer to a vector h. Gated attention gives each passage of a document the weight
``softmax(w . (tanh(V h) * sigmoid(U h)))``; the weighted mean of the h is classified by a
logistic unit. Encoder, attention and classifier are learned together from document labels
by Adam with hand-written gradients in numpy, on the driver, over a bounded sample of
labelled rows (see ``labelled``). Scoring broadcasts the fixed-size model and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import LOWER, VISIBLE, fold, mix64, parts, prepare, run_hashes, slices, text_buffer, word_runs

PASSAGE_WORDS = 64
TRIGRAM_BITS = 8
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 12, 64, 0.01
#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 2000
SLICE = 1 << 20

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_HIGH = np.arange(256) >= 128
_LINE = np.arange(256) == 10
_STATS = 12


def passages(data: np.ndarray, offsets: np.ndarray):
    """Features of every passage, and the passages before each text; a text without words has one empty passage."""
    starts, ends, before = word_runs(data, VISIBLE, offsets)
    n_words = np.diff(before)
    parts = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(parts)])
    text = np.repeat(np.arange(len(parts)), parts)
    k = np.arange(first[-1]) - first[text]
    a = before[text] + k * PASSAGE_WORDS
    b = np.minimum(a + PASSAGE_WORDS, before[text + 1])
    size = b - a
    full = size > 0
    lo, hi = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    if full.any():
        lo[full], hi[full] = starts[a[full]], ends[b[full] - 1]
    return _encoded(data, starts, ends, a, b, lo, hi, np.maximum(size, 1)), first


def _within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[hi] - sums[lo]


def _encoded(data, starts, ends, a, b, lo, hi, size):
    n, m = len(lo), len(data)
    out = np.zeros((n, (1 << TRIGRAM_BITS) + _STATS), np.float32)
    out[:, -1] = np.log1p(size) / 4
    if m == 0 or n == 0:
        return out
    length = np.maximum(hi - lo, 1).astype(np.float32)
    owner = np.full(m, -1, np.int64)
    full = np.flatnonzero(hi > lo)
    owner[:] = -1
    mark = np.zeros(m + 1, np.int64)
    np.add.at(mark, lo[full], full + 1)
    np.add.at(mark, hi[full], -(full + 1))
    owner = np.cumsum(mark[:m]) - 1
    if m >= 3:
        v = data.astype(np.uint64)
        gram = (mix64((v[:-2] << np.uint64(16)) | (v[1:-1] << np.uint64(8)) | v[2:]) >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64)
        same = (owner[:-2] >= 0) & (owner[:-2] == owner[2:])
        counts = np.bincount((owner[:-2][same] << TRIGRAM_BITS) + gram[same], minlength=n << TRIGRAM_BITS)
        out[:, : 1 << TRIGRAM_BITS] = np.sqrt(counts.reshape(n, -1) / length[:, None])
    s = out[:, 1 << TRIGRAM_BITS :]
    for i, table in enumerate((_UPPER, _DIGIT, _MARK, _HIGH, _LINE)):
        s[:, i] = _within(table[data], lo, hi) / length
    if len(starts):
        words = run_hashes(LOWER[data], starts, ends)
        again = np.concatenate([[False], words[1:] == words[:-1]])
        again[a[b > a]] = False  # passages know nothing of each other
        s[:, 5] = _within(again, a, b) / size
        order = np.lexsort((words, np.repeat(np.arange(n), b - a))) if (b - a).sum() == len(words) else np.arange(len(words))
        group = np.repeat(np.arange(n), b - a)[order] if (b - a).sum() == len(words) else np.zeros(len(words), np.int64)
        twice = np.zeros(len(words), bool)
        twice[1:] = (words[order][1:] == words[order][:-1]) & (group[1:] == group[:-1])
        s[:, 6] = np.bincount(group[twice], minlength=n)[:n] / size
        width = ends - starts
        s[:, 7] = np.log1p(_within(width, a, b) / size)
        s[:, 8] = _within(_MARK[data[starts]], a, b) / size
        s[:, 9] = _within(_MARK[data[ends - 1]], a, b) / size
        s[:, 10] = _within(width > 20, a, b) / size
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    params: list[np.ndarray]
    cut: float = 0.0

    def logits(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        return _forward(self.params, x, first)[0] - self.cut


def _softmax(score: np.ndarray, first: np.ndarray) -> np.ndarray:
    sizes = np.diff(first)
    top = np.repeat(np.maximum.reduceat(score, first[:-1]), sizes)
    e = np.exp(score - top)
    return e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)


def _forward(params, x, first):
    encode, shift, v, u, w, out, bias = params
    h = np.maximum(x @ encode + shift, 0)
    t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    weight = _softmax((t * g) @ w, first)
    pooled = np.add.reduceat(weight[:, None] * h, first[:-1], axis=0)
    return pooled @ out + bias[0], h, t, g, weight, pooled


def _gradients(params, x, first, label, balance):
    encode, shift, v, u, w, out, bias = params
    z, h, t, g, weight, pooled = _forward(params, x, first)
    d = ((1 / (1 + np.exp(-z)) - label) * balance).astype(np.float32)
    sizes = np.diff(first)
    d_pooled = np.repeat(d[:, None] * out, sizes, axis=0)
    d_weight = (d_pooled * h).sum(axis=1)
    d_score = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, first[:-1]), sizes))
    d_t, d_g = d_score[:, None] * w * g, d_score[:, None] * w * t
    d_t, d_g = d_t * (1 - t * t), d_g * g * (1 - g)
    d_h = (weight[:, None] * d_pooled + d_t @ v.T + d_g @ u.T) * (h > 0)
    return [x.T @ d_h, d_h.sum(axis=0), h.T @ d_t, h.T @ d_g, (t * g).T @ d_score, pooled.T @ d, np.array([d.sum()], np.float32)]


def train(texts: list[str], label: np.ndarray, *, epochs=EPOCHS, seed=11) -> Model:
    """Fit to whole texts; the cut is set where a held-back fifth is parted best. Without both classes scores are those of the one seen (class 1 if none)."""
    label = np.asarray(label, np.float32)
    width = (1 << TRIGRAM_BITS) + _STATS
    zeros = [np.zeros(s, np.float32) for s in ((width, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,))]
    if len(texts) == 0 or label.min() == label.max():
        return Model(np.zeros(width, np.float32), np.ones(width, np.float32), zeros, 8.0 if len(texts) and label[0] == 0 else -8.0)
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    parts, firsts = [], [np.zeros(1, np.int64)]
    for a, b in slices(offsets, SLICE):
        part = offsets[a : b + 1]
        features, first = passages(data[part[0] : part[-1]], part - part[0])
        parts.append(features)
        firsts.append(first[1:] + firsts[-1][-1])
    x, first = np.concatenate(parts), np.concatenate(firsts)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / spread).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [(rng.standard_normal(p.shape) / np.sqrt(max(p.shape[0], 1))).astype(np.float32) if p.ndim == 2 else p for p in zeros]
    params[4] = (rng.standard_normal(GATE) * 0.3).astype(np.float32)
    params[5] = (rng.standard_normal(HIDDEN) * 0.3).astype(np.float32)
    fit = np.flatnonzero(np.arange(len(texts)) % 5 != 0)
    if len(set(label[fit].tolist())) < 2:
        fit = np.arange(len(texts))
    even = np.where(label == 1, 0.5 / (label[fit] == 1).mean(), 0.5 / (label[fit] == 0).mean()).astype(np.float32)
    one, two, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = first[chosen + 1] - first[chosen]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.repeat(first[chosen] - begin[:-1], sizes) + np.arange(begin[-1])
            grads = _gradients(params, x[rows], begin, label[chosen], even[chosen] / len(chosen))
            step += 1
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for p, g, m, v in zip(params, grads, one, two):
                g = g + np.float32(1e-4) * p
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                p -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    back = np.setdiff1d(np.arange(len(texts)), fit)
    if len(set(label[back].tolist())) < 2:
        back = np.arange(len(texts))
    logit = _forward(params, x, first)[0][back]
    weight = np.where(label[back] == 1, 0.5 / (label[back] == 1).sum(), 0.5 / (label[back] == 0).sum())
    return Model(mean.astype(np.float32), spread.astype(np.float32), params, labelled.best_cut(logit, label[back], weight))


def fit(docs: DataFrame, labels: DataFrame, *, modulus=3, held_out=1, target="quality", per_class=PER_CLASS, **names) -> Model:
    """A model learned from a bounded sample of labelled rows outside the held-out fold."""
    rows = labelled.sample(docs, labels, target, modulus, held_out, per_class=per_class, **names)
    return train(rows["text"].tolist(), rows["label"].to_numpy())


_SCHEMA = "doc_id long, text string, held_out boolean, score double, n_passages long"


def score(docs: DataFrame, model: Model, *, modulus=3, held_out=1, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, text, held_out, score, n_passages`` of every whole text.

    A null or empty text is one empty passage and has a score too. A null id is never held
    out. Rows that repeat and texts that tie stay as they are: a score depends on the text
    alone. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in parts(batches, "quality_text"):
            data, offsets = text_buffer(batch.column("quality_text"))
            value, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
            for a, b in slices(offsets, SLICE):
                part = offsets[a : b + 1]
                features, first = passages(data[part[0] : part[-1]], part - part[0])
                value[a:b], count[a:b] = held.value.logits(features, first), np.diff(first)
            value = 1 / (1 + np.exp(-np.clip(value, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(value, pa.float64()), pa.array(count, pa.int64())], ["doc_id", "text", "held_out", "score", "n_passages"])

    rows = docs.select(F.col(doc_id).cast("long").alias("quality_id"), F.col(text).alias("quality_text"), F.coalesce(fold(doc_id, modulus) == held_out, F.lit(False)).alias("quality_held_out"))
    return rows.mapInArrow(run, _SCHEMA)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A text is a bag of subwords: each word (A-Z lowered) and its character n-grams of 3 to 6
bytes with word-boundary marks, hashed to a fixed number of buckets. Every bucket has a
small vector; the mean vector of a text goes through a linear softmax. Vectors and softmax
are trained jointly in numpy, on the driver, over a bounded sample of labelled rows (see
``labelled``). Misspellings and unseen inflections share n-gram vectors with what was learned.

For scoring, a bucket's vector times the softmax's weight difference is one number, so an
executor gets one float per bucket (a broadcast of fixed size) and the logit of a text is the
mean of its buckets' numbers: plain array lookups over the bytes of a batch, without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import LOWER, WORD, fold, mix64, parts, prepare, run_hashes, slices, text_buffer, tidied, tidy, word_runs

BITS = 18
GRAMS = (3, 4, 5, 6)
DIM = 8
#: Neutral subwords that every text has besides its own, so that a few odd ones don't decide a short text.
PADDING = 200
EPOCHS = 100
#: Buckets whose share of texts differs less between the classes (two-proportion z) are pruned; tried in turn.
LEAST_Z = (4.0, 6.0, 8.0, 10.0)
#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 1500
_EDGE = 1  # a byte that no word has

#: Bytes of text that are looked at together; their subwords take over 200 times as much memory for a moment.
SLICE = 64 << 10
#: Entries of bags that are summed at once.
SUMMED = 1 << 14


def _marked(data: np.ndarray, offsets: np.ndarray):
    """Words with an edge mark on both sides, end to end: bytes, place of each word, words before each text."""
    data = LOWER[data]
    starts, ends, before = word_runs(data, WORD, offsets)
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(at[-1]), _EDGE, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    mask = WORD[data]
    out[inside] = data[mask]
    return out, at, before


def subwords(out: np.ndarray, at: np.ndarray, grams=GRAMS, bits=BITS):
    """(bucket, position) arrays of all subwords of words laid out by :func:`_marked`: one pair for the words, one for each n-gram size."""
    shift = np.uint64(64 - bits)
    n = len(out)
    if n == 0:
        return
    yield (run_hashes(out, at[:-1], at[1:]) >> shift).astype(np.int64), at[:-1]
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # bytes to the word's end
    value = out.astype(np.uint64)
    size = 1
    for g in grams:
        while size < g:
            if n - size <= 0:
                return
            value = value[: n - size] * np.uint64(0x100000001B3) + out[size:].astype(np.uint64) + np.uint64(7)
            size += 1
        where = np.flatnonzero(left[: n - g + 1] >= g)
        yield (mix64(value[where] + np.uint64(g)) >> shift).astype(np.int64), where


@dataclass
class Model:
    """weights: one float per bucket; a text's logit is their mean over its subwords, plus the bias."""

    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for a, b in slices(offsets, SLICE):
            part = offsets[a : b + 1]
            out, at, before = _marked(data[part[0] : part[-1]], part - part[0])
            edges = at[before]
            for bucket, where in subwords(out, at):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket], dtype=np.float64)])
                cut = np.searchsorted(where, edges)
                total[a:b] += sums[cut[1:]] - sums[cut[:-1]]
                count[a:b] += np.diff(cut)
        return total / (count + PADDING) + self.bias


def _bags(texts: list[str], bits: int):
    """Entries (text, bucket, times) by text, then bucket: some texts at a time."""
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    for a, b in slices(offsets, SLICE):
        part = offsets[a : b + 1]
        out, at, before = _marked(data[part[0] : part[-1]], part - part[0])
        edges = at[before]
        keys = [np.zeros(0, np.int64)]
        for bucket, where in subwords(out, at, bits=bits):
            keys.append(((np.searchsorted(edges, where, side="right") - 1 + a) << bits) + bucket)
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        yield (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32), count.astype(np.float32)


def _sums(values: np.ndarray, which: np.ndarray, share: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values[which] * share``, some at a time; ``starts`` has one more entry than there are sums."""
    out = np.zeros((len(starts) - 1, values.shape[1]), values.dtype)
    for a, b in slices(starts, SUMMED):
        at = starts[a : b + 1]
        full = at[1:] > at[:-1]
        if full.any():
            out[a:b][full] = np.add.reduceat(values[which[at[0] : at[-1]]] * share[at[0] : at[-1]], at[:-1][full] - at[0], axis=0)
    return out


def train(texts: list[str], label: np.ndarray, *, dim=DIM, bits=BITS, epochs=EPOCHS, rate=0.05, seed=7, least_z=LEAST_Z) -> Model:
    """Fit vectors and softmax together by full-batch Adam; the bias is set where a held-back fifth is parted best.

    Buckets found in about as many texts of either class (a z below the least) are pruned:
    their vectors stay zero, though they count in the mean. The others start along one
    direction, in proportion to z, beside noise in all. Of the values in ``least_z`` the one stays that parts the
    held-back fifth with the smallest mean error of the classes. Without texts of both classes
    every score is that of class 0 (or 1, if only that was seen).
    """
    label = np.asarray(label, np.int64)
    if len(texts) == 0 or label.min() == label.max():
        return Model(np.zeros(1 << bits, np.float32), 8.0 if len(texts) and label[0] else -8.0)
    fit = np.arange(len(texts)) % 5 != 0
    if len(set(label[fit].tolist())) < 2:
        fit[:] = True
    one, zero, total = np.zeros(1 << bits), np.zeros(1 << bits), np.full(len(texts), float(PADDING))
    for doc, column, times in _bags(texts, bits):
        total += np.bincount(doc, times, len(texts))
        one += np.bincount(column[(label[doc] == 1) & fit[doc]], minlength=1 << bits)
        zero += np.bincount(column[(label[doc] == 0) & fit[doc]], minlength=1 << bits)
    all_one, all_zero = (label[fit] == 1).sum(), (label[fit] == 0).sum()
    pooled = (one + zero + 0.5) / (fit.sum() + 1)
    z = (one / all_one - zero / all_zero) / np.sqrt(pooled * (1 - pooled).clip(1e-9) * (1 / all_one + 1 / all_zero))
    # only entries of buckets that some threshold keeps are gathered
    useful, parts = np.abs(z) >= min(least_z), []
    for doc, column, times in _bags(texts, bits):
        keep = useful[column]
        parts.append((doc[keep], column[keep], (times[keep] / total[doc[keep]]).astype(np.float32)))
    doc, column, share = (np.concatenate(x) for x in zip(*parts))
    del parts
    back = ~fit if len(set(label[~fit].tolist())) == 2 else np.ones(len(texts), bool)
    even = np.where(label == 1, 0.5 / (label[back] == 1).sum(), 0.5 / (label[back] == 0).sum())[back]
    best: tuple[float, Model] | None = None
    for least in least_z:
        used = np.flatnonzero((np.abs(z) >= least) & (one + zero >= min(3, fit.sum())))
        if not len(used) and best:
            break
        weights, logit = _joint(doc, column, share, label, fit, used, z, least, dim, bits, epochs, rate, seed)
        cut = labelled.best_cut(logit[back], label[back], even)
        error = float((even * ((logit[back] >= cut) != label[back])).sum())
        if best is None or error <= best[0]:
            best = (error, Model(weights, -cut))
    return best[1]


def _joint(doc, column, share, label, fit, used, z, least, dim, bits, epochs, rate, seed):
    """Weights of all buckets and logits (without bias) of the texts, from the buckets ``used``."""
    n, weights = len(label), np.zeros(1 << bits, np.float32)
    if not len(used):
        return weights, np.zeros(n)
    rng = np.random.default_rng(seed)
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    keep = place[column] >= 0
    doc, column, share = doc[keep], place[column[keep]], share[keep][:, None]
    rows = np.searchsorted(doc, np.arange(n + 1))
    order = np.argsort(column, kind="stable")
    by_column, column_share = doc[order], share[order]
    column_rows = np.searchsorted(column[order], np.arange(len(used) + 1))
    line = rng.standard_normal(dim)
    line /= np.linalg.norm(line)
    vectors = (np.sign(z[used]) * (np.abs(z[used]) - least + 0.1) / 10)[:, None] * line + rng.standard_normal((len(used), dim)) * 0.02
    vectors, out, bias = vectors.astype(np.float32), np.stack([-line, line], axis=1).astype(np.float32), np.zeros(2, np.float32)
    balance = (np.where(label == 1, 0.5 / (label[fit] == 1).sum(), 0.5 / (label[fit] == 0).sum()) * fit)[:, None]
    params = [vectors, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    start = _sums(vectors, column, share, rows)
    scale = np.float32(3 / max(1e-9, np.abs(start @ line)[fit & (label == 1)].mean()))
    for step in range(1, epochs + 1):
        mean = _sums(vectors, column, share, rows) * scale
        s = mean @ out + bias
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), label] -= 1
        p = (p * balance).astype(np.float32)
        to_mean = (p @ out.T) * scale
        grads = [_sums(to_mean, by_column, column_share, column_rows) + np.float32(1e-6) * vectors, mean.T @ p + np.float32(1e-4) * out, p.sum(axis=0)]
        for x, g, m, v in zip(params, grads, first, second):
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            x -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = (vectors @ (out[:, 1] - out[:, 0])) * scale
    return weights, _sums(weights[used][:, None], column, share, rows)[:, 0].astype(float)


_SCHEMA = "doc_id long, text string, held_out boolean, score double"


def fit(docs: DataFrame, labels: DataFrame, *, modulus=5, held_out=0, target="toxic", per_class=PER_CLASS, **names) -> Model:
    """A model learned from a bounded sample of labelled rows outside the held-out fold."""
    rows = labelled.sample(docs, labels, target, modulus, held_out, per_class=per_class, **names)
    texts, label = rows["text"].tolist(), rows["label"].to_numpy()
    del rows
    tidy(docs.sparkSession)
    model = train(texts, label)
    del texts, label
    tidy(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, *, modulus=5, held_out=0, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, text, held_out, score`` of every whole text.

    A null or empty text, or one without words, gets the score of the bias alone. A null id
    is never held out. Rows that repeat and texts that tie stay as they are: a score depends on
    the text alone. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in parts(batches, "toxic_text"):
            data, offsets = text_buffer(batch.column("toxic_text"))
            value = 1 / (1 + np.exp(-np.clip(held.value.logits(data, offsets), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(value, pa.float64())], ["doc_id", "text", "held_out", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("toxic_id"), F.col(text).alias("toxic_text"), F.coalesce(fold(doc_id, modulus) == held_out, F.lit(False)).alias("toxic_held_out"))
    return rows.mapInArrow(tidied(run), _SCHEMA)


def kept(docs: DataFrame, model: Model, *, text="text", below=0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``below`` or more; all columns stay as they are."""
    spark = docs.sparkSession
    prepare(spark)
    held, place = spark.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for batch in parts(batches, place):
            value = 1 / (1 + np.exp(-np.clip(held.value.logits(*text_buffer(batch.column(place))), -60, 60)))
            yield batch.filter(pa.array(value < below))

    return docs.mapInArrow(tidied(run), docs.schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

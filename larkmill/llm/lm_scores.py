"""Language-model scores by online logistic context mixing, beside a unigram base.

The model predicts a text (A-Z lowered, closed by an end byte) bit by bit. For contexts of
one to five preceding bytes, hashed tables hold how often each bit followed; their
predictions are combined in the logistic domain by weights that a gate selects (the bit's
place and how much the long contexts have seen), and the result is refined by an adaptive
probability map over the preceding byte. A few ways to mix the mixture, its refinement and the
second order once more (``WAYS``) run beside each other; along each text their shares follow
how well they have predicted it so far, block after block. The costs sum to the log10
probability.

* What the mixture says of a bit depends on six bytes only. Spark counts the distinct six-byte
  windows of **all** training documents, whole, in a table that everything is learned from.
* Bit tables: every partition folds its windows into arrays, and Spark sums these block by
  block, at most ``FAN_IN`` at once. The tables grow with the input up to ``MOST_BITS``; only
  they and the weights are broadcast (at most about 50 MB; while learning, counts of 100 MB).
* Mixing weights have the least cost over all training text: each gate's are a logistic
  regression, found by damped Newton steps, whose sums Spark takes over all windows. The map is
  then averaged over all windows. Each bit is predicted from the other occurrences of its
  contexts: its own is subtracted from the counts.
* Workers remember what the mixture says by window.

The base counts every token of the training documents. Workers list the distinct tokens of
their part of the input; counts are summed by token and joined back to each part, which keeps
its documents' tokens as references. A frequent token is one row per part, not one per
document, and nothing that grows with the vocabulary reaches the driver.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, VISIBLE, again, fold, materialize, mix64, pack, parts, prepare, release, slices, text_buffer, tidy, unpack, word_hashes, word_runs

ORDERS = 5
#: Table bits for contexts of 1 to 5 bytes, from the least input on; they grow with it up to these.
LEAST_BITS, MOST_BITS = (16, 18, 19, 20, 20), (16, 20, 21, 22, 22)
BLOCK = 1 << 16
#: Tables of partitions that are summed at once.
FAN_IN = 64
#: Steps of learning the weights at most, and the share of the cost under which a step's gain ends it.
STEPS, GAIN = 8, 1e-3
#: Bytes of input for each part of the table of windows; windows that a worker learns from at once.
TABLE_BYTES, LEARNED_TOGETHER = 16 << 20, 1 << 15
SLICE = 1 << 20
#: Bytes of text whose tokens are listed together.
PART_BYTES = 8 << 20
CACHE_BITS = 21
#: Weights of the mixture, its refinement and the second order in the logistic domain, each a way to mix them.
WAYS = np.array([[0.5, 0.5, 0.0], [1.0, 0.15, 0.0], [0.0, 0.9, 0.0], [0.3, 0.3, 0.3]])
#: Bytes of a text after which the ways' shares are renewed, and what part is dealt evenly then.
RENEW, EVEN = 128, 0.02
_LEVELS = 33
_FLOOR = 2e-5


def bits_for(size: int) -> tuple[int, ...]:
    """Table bits for so many bytes of input: about a slot for each eight bytes in the largest tables."""
    grown = max(0, math.ceil(math.log2(max(size, 1))) - 3)
    return tuple(min(most, max(least, grown)) for least, most in zip(LEAST_BITS, MOST_BITS))


def windows(data: np.ndarray, offsets: np.ndarray):
    """For each byte of each text and its end byte: the five bytes before it and itself, in one number; and where texts start."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.zeros(int(at[-1]), np.uint64)
    ends = np.zeros(len(out), bool)
    ends[at[1:] - 1] = True
    out[~ends] = LOWER[data]
    since = np.arange(len(out)) - np.repeat(at[:-1], np.diff(at))
    key = out.copy()
    for k in range(1, ORDERS + 1):
        key[k:] |= np.where(since[k:] >= k, out[:-k] << np.uint64(8 * k), np.uint64(0)) if k < len(out) else key[k:]
    return key, at


def slot(key: np.ndarray, order: int, node: np.ndarray, bits: int) -> np.ndarray:
    """Place of a bit's context in the table of ``order``; ``node`` tells the bits of the byte before this one."""
    context = (key >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    value = (context << np.uint64(8)) | node
    if order == 1:
        return value.astype(np.int64)
    return (mix64(value + np.uint64(order)) >> np.uint64(64 - bits)).astype(np.int64)


def bits_of(key: np.ndarray):
    """(place, node, bit) of the eight bits of each window's last byte."""
    byte = key & np.uint64(255)
    for j in range(8):
        yield j, (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j)), ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)


def _stretched(zeros: np.ndarray, ones: np.ndarray):
    """A table's prediction in the logistic domain and how much it has seen (0..15)."""
    n = zeros + ones
    stretch = np.where(n > 0, np.log((ones + 0.2) / (zeros + 0.2)), 0)
    return np.clip(stretch, -12, 12), np.minimum(15, np.ceil(np.log2(n + 1))).astype(np.uint8)


@dataclass
class Model:
    """stretch: predictions of each table in the logistic domain; sure: how much each entry has seen (0..15)."""

    bits: tuple[int, ...]
    stretch: list[np.ndarray]
    sure: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    def _inputs(self, key, j, node, counts=None, bit=None):
        """Inputs and gate of a bit; with ``counts``, from all occurrences but the bit's own."""
        x = np.empty((len(key), ORDERS + 1), np.float32)
        x[:, ORDERS] = 0.3
        gate = np.full(len(key), j, np.int64)
        for order in range(1, ORDERS + 1):
            s = slot(key, order, node, self.bits[order - 1])
            if counts is None:
                x[:, order - 1], sure = self.stretch[order - 1][s], self.sure[order - 1][s]
            else:
                seen = counts[order - 1].reshape(-1, 2)[s].astype(np.float64)
                seen[np.arange(len(bit)), bit] = np.maximum(seen[np.arange(len(bit)), bit] - 1, 0)
                x[:, order - 1], sure = _stretched(seen[:, 0], seen[:, 1])
            if order >= 3:
                gate = gate * 4 + _GATE[sure]
        return x, gate

    def _map(self, key, node, z):
        row, low, part = _levels(key, node, z)
        return self.refined[row, low] * (1 - part) + self.refined[row, low + 1] * part

    def costs(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each window's last byte by each way: (window, way)."""
        out = np.zeros((len(key), len(WAYS)))
        for j, node, bit in bits_of(key):
            x, gate = self._inputs(key, j, node)
            z = np.clip((self.weights[gate] * x).sum(axis=1), -12, 12)
            p = np.clip(self._map(key, node, z), _FLOOR, 1 - _FLOOR)
            mixed = np.stack([z, np.log(p / (1 - p)), x[:, 1]], axis=1) @ WAYS.T
            p = np.clip(1 / (1 + np.exp(-np.clip(mixed, -12, 12))), _FLOOR, 1 - _FLOOR)
            out += np.log10(np.where(bit[:, None] == 1, p, 1 - p))
        return out

    def sums(self, key: np.ndarray, times: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
        """Of each gate, the windows' cost in nats, its falling gradient and its curvature (lower triangle) by the weights."""
        gates, n = len(self.weights), ORDERS + 1
        out = np.zeros((gates, 1 + n + len(_LOWER[0])))
        for j, node, bit in bits_of(key):
            x, gate = self._inputs(key, j, node, counts, bit)
            p = 1 / (1 + np.exp(-np.clip((self.weights[gate] * x).sum(axis=1, dtype=np.float64), -12, 12)))
            error, curve = times * (bit - p), times * p * (1 - p)
            out[:, 0] -= np.bincount(gate, times * np.log(np.where(bit == 1, p, 1 - p)), gates)
            for i in range(n):
                out[:, 1 + i] += np.bincount(gate, error * x[:, i], gates)
            for at, (i, k) in enumerate(zip(*_LOWER), 1 + n):
                out[:, at] += np.bincount(gate, curve * x[:, i] * x[:, k], gates)
        return out

    def cells(self, key: np.ndarray, times: np.ndarray, counts: list[np.ndarray]):
        """Cells of the map that the windows meet, with how much and how much of it for ones, in 65536ths."""
        cells, mass, ones = [], [], []
        for j, node, bit in bits_of(key):
            x, gate = self._inputs(key, j, node, counts, bit)
            row, low, part = _levels(key, node, (self.weights[gate] * x).sum(axis=1))
            part = np.rint(part * 65536).astype(np.int64)
            for place, share in ((low, 65536 - part), (low + 1, part)):
                cells.append(row * _LEVELS + place)
                mass.append(share * times)
                ones.append(share * times * bit)
        cell, first = np.unique(np.concatenate(cells), return_inverse=True)
        order = np.argsort(first, kind="stable")
        begin = np.searchsorted(first[order], np.arange(len(cell)))
        return cell, np.add.reduceat(np.concatenate(mass)[order], begin), np.add.reduceat(np.concatenate(ones)[order], begin)

    def learn(self, key: np.ndarray, counts: list[np.ndarray]) -> None:
        """Weights and map from these windows, each as often as it occurs."""
        key, times = np.unique(key, return_counts=True)
        if len(key):
            _learn(self, lambda: self.sums(key, times, counts), lambda: self.cells(key, times, counts))


def _levels(key, node, z):
    """Row and lower level of the map, and what part falls to the level above."""
    row = (((key >> np.uint64(8)) & np.uint64(255)) << np.uint64(8) | node).astype(np.int64)
    at = (np.clip(z, -7.99, 7.99) + 8) * ((_LEVELS - 1) / 16)
    low = at.astype(np.int64)
    return row, low, (at - low).astype(np.float32)


_LOWER = np.tril_indices(ORDERS + 1)


def _learn(model: Model, summed, celled) -> None:
    """Newton steps, damped gate by gate: a gate's step that raises its cost is taken back, and a shorter one tried.

    ``summed`` and ``celled`` give :meth:`Model.sums` and :meth:`Model.cells` of all windows.
    """
    n, gates = ORDERS + 1, len(model.weights)
    best, held = model.weights.copy(), None
    damping = np.full(gates, 0.1)
    for step in range(STEPS):
        found = summed()
        if held is None:
            held, gain = found, np.inf
        else:
            better = found[:, 0] < held[:, 0]
            gain = (held[better, 0] - found[better, 0]).sum()
            best[better], held[better] = model.weights[better], found[better]
            damping *= np.where(better, 0.25, 8)
        if gain <= GAIN * held[:, 0].sum() or step == STEPS - 1:
            break
        curve = np.zeros((gates, n, n))
        curve[:, _LOWER[0], _LOWER[1]] = curve[:, _LOWER[1], _LOWER[0]] = held[:, 1 + n :]
        size = np.einsum("gii->gi", curve)
        curve += np.eye(n) * (1 + damping[:, None] * (1 + size + 1e-3 * size.max(axis=1, keepdims=True)))[:, None, :]
        moved = best + np.linalg.solve(curve, held[:, 1 : 1 + n, None])[:, :, 0]
        model.weights = (np.rint(moved * 65536) / 65536).astype(np.float32)  # the order of sums doesn't show
    model.weights = best
    cell, mass, ones = celled()
    flat = model.refined.reshape(-1)
    flat[cell] = (ones / 65536 + 30 * flat[cell]) / (mass / 65536 + 30)


_GATE = np.array([0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3])


def untrained(bits=LEAST_BITS) -> Model:
    levels = np.linspace(-8, 8, _LEVELS)
    weights = np.full((8 * 64, ORDERS + 1), 0.2, np.float32)
    weights[:, ORDERS] = 0
    return Model(bits, [np.zeros(1 << b, np.float16) for b in bits], [np.zeros(1 << b, np.uint8) for b in bits], weights, np.tile((1 / (1 + np.exp(-levels))).astype(np.float32), (1 << 16, 1)))


def along(costs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of each text from its bytes' ``costs`` by each way; ``at`` tells where texts begin.

    All texts at once, block by block: a block's probability is that of the ways by their
    shares, which are renewed by it.
    """
    n, ways = len(at) - 1, costs.shape[1]
    total, share = np.zeros(n), np.full((n, ways), 1 / ways)
    if not n:
        return total
    blocks = -(-np.diff(at) // RENEW)  # one at least: every text has an end
    first = np.concatenate([[0], np.cumsum(blocks)])
    begin = np.repeat(at[:-1], blocks) + RENEW * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    sums = np.add.reduceat(costs.astype(np.float64), begin, axis=0)
    for t in range(int(blocks.max())):
        rows = np.flatnonzero(blocks > t)
        cost = sums[first[rows] + t]
        best = cost.max(axis=1, keepdims=True)
        likely = share[rows] * 10 ** (cost - best)
        whole = likely.sum(axis=1)
        total[rows] += best[:, 0] + np.log10(whole)
        share[rows] = (1 - EVEN) * likely / whole[:, None] + EVEN / ways
    return total


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]):
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts)).astype(np.int64)


class _Windows:
    """Distinct windows with counts, of bounded size."""

    def __init__(self, limit: int = 4_000_000):
        self.keys, self.counts, self.size, self.limit = [], [], 0, limit

    def add(self, data, offsets):
        for a, b in slices(offsets, SLICE):
            part = offsets[a : b + 1]
            key, _ = windows(data[part[0] : part[-1]], part - part[0])
            key, count = np.unique(key, return_counts=True)
            self.keys.append(key)
            self.counts.append(count)
            self.size += len(key)
        if self.size > self.limit:
            key, count = self.take()
            self.keys, self.counts, self.size = [key], [count], len(key)

    def take(self):
        return _merged(self.keys, self.counts) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _count_bits(tables, key, count, bits):
    for at in range(0, len(key), 1 << 18):
        k, c = key[at : at + (1 << 18)], count[at : at + (1 << 18)].astype(np.uint32)
        for _, node, bit in bits_of(k):
            for order in range(1, ORDERS + 1):
                np.add.at(tables[order - 1], slot(k, order, node, bits[order - 1]) * 2 + bit, c)


_BLOCKS = "block int, part int, counts binary"


def _listed_windows(batches):
    """Distinct windows of texts, with how often they occur; a window may come again."""
    held = _Windows()

    def flushed():
        key, count = held.take()
        for a in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)].view(np.int64)), pa.array(count[a : a + (1 << 16)])], ["key", "times"])

    for batch in parts(batches, 0):
        held.add(*text_buffer(batch.column(0)))
        if held.size > held.limit // 2:
            merged, held = held.take(), _Windows()
            held.keys, held.counts, held.size = [merged[0]], [merged[1]], len(merged[0])
            if held.size > held.limit // 4:
                yield from flushed()
                held = _Windows()
    yield from flushed()


def _keys(batch: pa.RecordBatch):
    return np.asarray(batch.column("key")).view(np.uint64), np.asarray(batch.column("times"))


def _runs(batches):
    """Windows and their times, LEARNED_TOGETHER about at once."""
    held, size = [], 0
    for batch in batches:
        held.append(_keys(batch))
        size += batch.num_rows
        if size >= LEARNED_TOGETHER:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _counted(bits, listed: bool = False):
    """Bit counts of one partition's texts, or of its windows if they are ``listed``: one row for each block of each table."""

    def run(batches):
        held = _Windows()
        tables = [np.zeros(2 << b, np.uint32) for b in bits]
        seen = False
        for batch in batches if listed else parts(batches, 0):
            if listed:
                _count_bits(tables, *_keys(batch), bits)
            else:
                held.add(*text_buffer(batch.column(0)))
            if held.size > held.limit // 2:
                _count_bits(tables, *held.take(), bits)
                held = _Windows()
            seen = True
        if not seen:
            return
        _count_bits(tables, *held.take(), bits)
        part = TaskContext.get().partitionId()
        for order, array in enumerate(tables):
            for k in range(len(array) // (2 * BLOCK)):
                piece = array[2 * BLOCK * k : 2 * BLOCK * (k + 1)]
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([(order << 16) + k], pa.int32()), pa.array([part], pa.int32()), pa.array([pack(piece)], pa.binary())], ["block", "part", "counts"])

    return run


def _added(key, table):
    """The sum of up to FAN_IN partitions' counts of one block."""
    total = np.zeros(2 * BLOCK, np.int64)
    for blob in table.column("counts").to_pylist():
        total += unpack(blob, np.uint32)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([pack(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))], pa.binary())})


def fit(rows: DataFrame, total_bytes: int) -> Model:
    """``rows``: lm_id, lm_text, lm_training (from :func:`score`)."""
    spark = rows.sparkSession
    bits = bits_for(total_bytes)
    listed = rows.where("lm_training").select("lm_text").mapInArrow(_listed_windows, "key long, times long")
    listed = listed.repartition(min(4096, max(8, total_bytes // TABLE_BYTES)), "key").groupBy("key").agg(F.sum("times").alias("times"))
    listed = materialize(listed, "lm-windows")
    summed = listed.mapInArrow(_counted(bits, True), _BLOCKS)
    n = listed.rdd.getNumPartitions()
    while True:  # a tree of bounded fan-in; the last level has one row for each block
        n = -(-n // FAN_IN)
        summed = summed.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("block", "part").applyInArrow(_added, _BLOCKS)
        if n <= 1:
            break
    model = untrained(bits)
    counts = [np.zeros(2 << b, np.uint32) for b in bits]
    for r in summed.toLocalIterator():
        order, k = r["block"] >> 16, r["block"] & 0xFFFF
        counts[order][2 * k * BLOCK : 2 * (k + 1) * BLOCK] = piece = unpack(r["counts"], np.uint32)
        stretch, model.sure[order][k * BLOCK : (k + 1) * BLOCK] = _stretched(*piece.reshape(-1, 2).T.astype(np.float64))
        model.stretch[order][k * BLOCK : (k + 1) * BLOCK] = stretch
    shared = spark.sparkContext.broadcast(counts)
    del counts
    names = [f"c{k}" for k in range(1 + ORDERS + 1 + len(_LOWER[0]))]

    def all_sums():
        mixing = Model(bits, [], [], model.weights, np.zeros(0))

        def run(batches):
            total = sum(mixing.sums(key, times, shared.value) for key, times in _runs(batches))
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))], ["gate", *names])

        table = listed.mapInArrow(run, "gate int, " + ", ".join(f"{c} double" for c in names)).groupBy("gate").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        out = np.zeros((len(model.weights), len(names)))
        out[np.asarray(table.column("gate"))] = np.stack([np.asarray(table.column(c)) for c in names], axis=1)
        return out

    def all_cells():
        mixing = Model(bits, [], [], model.weights, np.zeros(0))

        def run(batches):
            for key, times in _runs(batches):
                yield pa.RecordBatch.from_arrays([*map(pa.array, mixing.cells(key, times, shared.value))], ["cell", "mass", "ones"])

        table = listed.mapInArrow(run, "cell long, mass long, ones long").groupBy("cell").agg(F.sum("mass").alias("mass"), F.sum("ones").alias("ones")).toArrow()
        return tuple(np.asarray(table.column(c)) for c in ("cell", "mass", "ones"))

    if not listed.isEmpty():
        _learn(model, all_sums, all_cells)
    shared.destroy()
    release(listed)
    return model


class _Remembered:
    """Costs by window: a direct-mapped table, filled as windows are met."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.full(1 << CACHE_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros((1 << CACHE_BITS, len(WAYS)), np.float16)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        place = (mix64(key) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.values[place]
        missed = np.flatnonzero(self.keys[place] != key)
        if len(missed):
            fresh, where = np.unique(key[missed], return_inverse=True)
            found = np.concatenate([self.model.costs(fresh[a : a + (1 << 16)]).astype(np.float16) for a in range(0, len(fresh), 1 << 16)])
            out[missed] = found[where]
            place = (mix64(fresh) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.keys[place], self.values[place] = fresh, found
        return out


_CACHES: dict[str, _Remembered] = {}

_PARTS = "part long, token long, times long, texts binary, flags binary, scores binary, sizes binary, refs binary, each binary"


def _row(part: int, **blobs) -> pa.RecordBatch:
    names = ["part", "token", "times", "texts", "flags", "scores", "sizes", "refs", "each"]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), *[pa.array([blobs[k]], pa.binary()) for k in names[3:]]], names)


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(text, token hash, times) of the distinct tokens of each text, the end token being 0."""
    text, value, times = [], [], []
    for a, b in slices(offsets, SLICE):
        part = offsets[a : b + 1]
        low = LOWER[data[part[0] : part[-1]]]
        starts, ends, before = word_runs(low, VISIBLE, part - part[0])
        h = np.concatenate([word_hashes(low, starts, ends), np.zeros(b - a, np.uint64)])
        owner = np.concatenate([np.repeat(np.arange(a, b), np.diff(before)), np.arange(a, b)])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
        text.append(owner[first])
        value.append(h[first])
        times.append(np.diff(np.append(first, len(h))))
    return np.concatenate(text), np.concatenate(value), np.concatenate(times)


def _listed(part: int, ids, known, training, texts: list, cached):
    """Rows of one part: its distinct tokens with their training counts, and its documents with references to them."""
    data = np.concatenate([d for d, _ in texts])
    sizes = np.concatenate([np.diff(o) for _, o in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    score = np.zeros(len(sizes))
    for a, b in slices(offsets, SLICE):
        cut = offsets[a : b + 1]
        key, at = windows(data[cut[0] : cut[-1]], cut - cut[0])
        score[a:b] = along(cached(key), at)
    text, value, times = _tokens(data, offsets)
    distinct, where = np.unique(value, return_inverse=True)
    count = np.bincount(where, times * training[text], len(distinct)).astype(np.int64)
    for a in range(0, len(distinct), 1 << 16):
        token = pa.array(distinct[a : a + (1 << 16)].view(np.int64))
        n = len(token)
        blank = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), token, pa.array(count[a : a + n]), *[blank] * 6], ["part", "token", "times", "texts", "flags", "scores", "sizes", "refs", "each"])
    yield _row(part, texts=pack(ids), flags=pack(np.stack([known, training, sizes])), scores=pack(score), sizes=pack(np.bincount(text, minlength=len(sizes)).astype(np.int32)), refs=pack(where.astype(np.int32)), each=pack(times.astype(np.int32)))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, *, modulus=7, held_out=2, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every whole text.

    ``bits_per_byte`` is the score's cost by the text's UTF-8 bytes and its end. A null or empty
    text has the end alone. A null id is not held out, and learned from. Rows that repeat are
    counted and scored as often as they occur; equal texts have equal scores. If nothing is
    learned from, all counts are zero and the model is untrained. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    out_of = F.coalesce(fold(doc_id, modulus) == held_out, F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("lm_id"), F.coalesce(F.col(text), F.lit("")).alias("lm_text"), (~out_of).alias("lm_training"))
    size = rows.agg(F.sum(F.octet_length("lm_text"))).first()[0] or 0
    model = spark.sparkContext.broadcast(fit(rows, size))
    tidy(spark)
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _CACHES:
            _CACHES.clear()
            _CACHES[name] = _Remembered(model.value)
        cached, part = _CACHES[name], TaskContext.get().partitionId() << 24
        ids, known, training, texts, held = [], [], [], [], 0

        def flushed():
            yield from _listed(part, np.concatenate(ids), np.concatenate(known), np.concatenate(training), texts, cached)

        for batch in parts(batches, "lm_text"):
            data, offsets = text_buffer(batch.column("lm_text"))
            column = batch.column("lm_id")
            ids.append(np.asarray(column.fill_null(0)))
            known.append(np.asarray(column.is_valid().cast(pa.int64())))
            training.append(np.asarray(batch.column("lm_training").cast(pa.int64())))
            texts.append((data.copy(), offsets.copy()))
            held += len(data)
            if held >= PART_BYTES:
                yield from flushed()
                ids, known, training, texts, held, part = [], [], [], [], 0, part + 1
        if ids:
            yield from flushed()

    held = materialize(rows.mapInArrow(run, _PARTS), "lm-parts")
    tokens = held.where("token is not null").select("part", "token", "times")
    # written, so that the join back is of plain shuffles and can be split at a token that every part has
    totals = materialize(tokens.groupBy("token").agg(F.sum("times").alias("total")), "lm-totals")
    n, v = totals.agg(F.sum("total"), F.sum((F.col("total") > 0).cast("long"))).first()
    n, v = n or 0, v or 0
    base = math.log10(n + v + 1)

    def joined(key, left, right):
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=_ARROW)
        token = np.asarray(right.column("token")).view(np.uint64)
        count = np.asarray(right.column("total"))[np.argsort(token)]
        r = left.to_pylist()[0]
        ids, flags, value = unpack(r["texts"], np.int64), unpack(r["flags"], np.int64).reshape(3, -1), unpack(r["scores"], np.float64)
        per_text, where, times = unpack(r["sizes"], np.int32), unpack(r["refs"], np.int32), unpack(r["each"], np.int32)
        first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
        c = count[where]
        tokens = np.add.reduceat(times.astype(np.int64), first)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=flags[0] == 0),
                "held_out": pa.array(flags[1] == 0),
                "n_tokens": pa.array(tokens),
                "n_known": pa.array(np.add.reduceat(times * (c > 0), first).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
                "base_score": pa.array(np.add.reduceat(times * np.log10(c + 1.0), first) - tokens * base),
                "score": pa.array(value),
                "bits_per_byte": pa.array(-value / math.log10(2) / (flags[2] + 1)),
            }
        )

    texts = again(held).where("texts is not null").select("part", "texts", "flags", "scores", "sizes", "refs", "each")
    counted = tokens.join(totals, "token").select(F.col("part").alias("of_part"), "token", "total")
    return texts.groupBy("part").cogroup(counted.groupBy("of_part")).applyInArrow(joined, _SCORED)


_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

"""Index probes: a sorted key list that is looked up instead of joined.

An index is a sorted array of keys with the number of rows of each. It is broadcast only up
to ``INDEX_BYTES``; a larger one is built and probed by parts: both sides are dealt to the
ranges of a learned distribution, and each range is indexed and probed in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.functions import models
from larkmill.session import ship

from .joins import partitions

INDEX_BYTES = 64 << 20
KINDS = ("sorted", "learned", "gapped")


class SortedIndex:
    """Binary search in the sorted distinct keys."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows

    def find(self, probes: np.ndarray) -> np.ndarray:
        """The position of each probe among the keys, or -1."""
        at = np.searchsorted(self.keys, probes)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == probes[hit]
        return np.where(hit, at, -1)

    def counts(self, probes: np.ndarray) -> np.ndarray:
        at = self.find(probes)
        return np.where(at >= 0, self.rows[np.maximum(at, 0)] if len(self.rows) else 0, 0)


class LearnedIndex(SortedIndex):
    """A model guesses the position; the search stays within the model's largest error on the keys."""

    def __init__(self, keys, rows, leaves: int = 256):
        super().__init__(keys, rows)
        self.model = models.train(keys, leaves)
        guess = self._guess(keys)
        self.error = int(np.abs(guess - np.arange(len(keys))).max(initial=0))

    def _guess(self, probes):
        return np.clip(np.rint(self.model.cdf(probes) * len(self.keys)), 0, max(len(self.keys) - 1, 0)).astype(np.int64)

    def find(self, probes):
        n = len(self.keys)
        if n == 0:
            return np.full(len(probes), -1)
        low = np.maximum(self._guess(probes) - self.error, 0)
        size = np.minimum(2 * self.error + 1, n - low)
        while (size > 1).any():  # branchless halving of every probe's window at once
            half = size // 2
            low = np.where((half > 0) & (self.keys[np.minimum(low + half, n - 1)] <= probes), low + half, low)
            size = size - half
        return np.where(self.keys[low] == probes, low, -1)


class GappedIndex(LearnedIndex):
    """Keys at the slots that a model names, with gaps between; probes search outwards in doubling steps."""

    def __init__(self, keys, rows, leaves: int = 256, spread: float = 1.5):
        super().__init__(keys, rows, leaves)
        n = len(keys)
        wanted = np.rint(self.model.cdf(keys) * n * spread).astype(np.int64)
        slots = np.maximum.accumulate(wanted - np.arange(n)) + np.arange(n) if n else wanted
        self.size = int(slots[-1]) + 1 if n else 0
        self.slot = slots
        # an empty slot holds the position of the next key, so every slot is searchable
        self.next = np.searchsorted(slots, np.arange(self.size)) if n else slots
        self.spread = spread

    def find(self, probes):
        n = len(self.keys)
        if n == 0:
            return np.full(len(probes), -1)
        guess = np.clip(np.rint(self.model.cdf(probes) * n * self.spread), 0, self.size - 1).astype(np.int64)
        start = self.next[guess]
        low, high, step = start.copy(), start.copy(), 1
        while True:
            left, right = (low > 0) & (self.keys[low] > probes), (high < n - 1) & (self.keys[high] < probes)
            if not (left.any() or right.any()):
                break
            low, high, step = np.where(left, np.maximum(low - step, 0), low), np.where(right, np.minimum(high + step, n - 1), high), step * 2
        while (low < high).any():
            middle = (low + high) // 2
            below = self.keys[middle] < probes
            low, high = np.where(below & (low < high), middle + 1, low), np.where(below, high, np.minimum(high, middle))
        return np.where(self.keys[low] == probes, low, -1)


_BUILD = {"sorted": SortedIndex, "learned": LearnedIndex, "gapped": GappedIndex}


def probe_counts(build: DataFrame, probe: DataFrame, key: str, kind: str = "learned", *, how: str = "inner", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``key, matches`` of every probe row that finds its key: the rows of ``build`` with it, or 1 with ``how="left_semi"``.

    Null keys find nothing. No key value is special.
    """
    if kind not in KINDS:
        raise ValueError(f"kind: {kind}")
    ship(probe.sparkSession)
    keys = build.select(F.col(key).cast("long").alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    probes = probe.select(F.col(key).cast("long").alias("key")).where("key is not null")
    semi = how == "left_semi"
    size = keys.count() * 16
    if size <= index_bytes:
        rows = keys.toPandas().sort_values("key")
        held = probe.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _BUILD[kind](*held.value)
            for batch in batches:
                yield _found(index, np.asarray(batch.column(0)), semi)

        return probes.mapInArrow(run, "key long, matches long")
    parts = max(partitions(probe.sparkSession), -(-size // index_bytes))
    place = models.fit(keys, "key").leaf_column("key", parts)

    def run_part(group, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(left.column("key")), kind="stable")
        index = _BUILD[kind](np.asarray(left.column("key"))[order], np.asarray(left.column("n"))[order])
        return pa.Table.from_batches([_found(index, np.asarray(right.column("key")), semi)])

    # probes of one key are reduced to a number first: a hot key is one row in its range
    reduced = probes.groupBy("key").agg(F.count(F.lit(1)).alias("times")).withColumn("part", place)
    found = keys.withColumn("part", place).groupBy("part").cogroup(reduced.groupBy("part")).applyInArrow(run_part, "key long, matches long")
    return probes.join(found, "key")


def _found(index: SortedIndex, probes: np.ndarray, semi: bool) -> pa.RecordBatch:
    n = index.counts(probes)
    hit = n > 0
    return pa.RecordBatch.from_arrays([pa.array(probes[hit]), pa.array(np.where(semi, 1, n[hit]).astype(np.int64))], ["key", "matches"])


def probe_total(build: DataFrame, probe: DataFrame, key: str, kind: str = "learned", **options) -> DataFrame:
    return probe_counts(build, probe, key, kind, **options).agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"))

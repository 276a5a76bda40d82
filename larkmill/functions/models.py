"""Two-level linear models of a key's cumulative distribution (CDF), and what they decide.

The root is a line through the least and the greatest sampled key; it picks one of M leaves,
each a line through its own sample keys. Leaf ends are forced to be monotone, so that a
greater key never gets a smaller bucket. A model is a few arrays of fixed size. Keys are
compared as doubles for placement only; equal keys always get equal buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a model is trained on, at most.
SAMPLE = 20_000
LEAVES = 1000


@dataclass
class CdfModel:
    """cdf(key) = level of the key's leaf, from ``low`` to ``high`` at the leaf's ends (first, last sampled key)."""

    least: float
    greatest: float
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.first)

    def leaf(self, keys: np.ndarray) -> np.ndarray:
        if self.greatest <= self.least:
            return np.zeros(len(keys), np.int64)
        scaled = (keys - self.least) / (self.greatest - self.least) * (self.leaves - 1)
        return np.clip(np.rint(scaled), 0, self.leaves - 1).astype(np.int64)

    def cdf(self, keys) -> np.ndarray:
        keys = np.asarray(keys, np.float64)
        k = self.leaf(keys)
        width = self.last[k] - self.first[k]
        part = np.where(width > 0, np.clip((keys - self.first[k]) / np.where(width > 0, width, 1), 0, 1), 0.0)
        return self.low[k] + part * (self.high[k] - self.low[k])

    def bucket(self, keys, buckets: int) -> np.ndarray:
        return np.clip(np.floor(self.cdf(keys) * buckets), 0, buckets - 1).astype(np.int64)

    def column(self, key: str, buckets: int) -> Column:
        """The bucket by the first level alone: arithmetic inside generated code."""
        width = self.greatest - self.least
        if width <= 0:
            return F.lit(0)
        place = (F.col(key).cast("double") - F.lit(self.least)) / F.lit(width)
        return _or_zero(key, F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(place * buckets))))

    def leaf_column(self, key: str, buckets: int) -> Column:
        """The bucket by both levels, as look-ups in constant arrays of the model's fixed size; stays in the JVM."""
        width = self.greatest - self.least
        if width <= 0:
            return F.lit(0)
        value = F.col(key).cast("double")
        leaf = F.rint((value - self.least) / width * (self.leaves - 1))
        leaf = F.greatest(F.lit(0), F.least(F.lit(self.leaves - 1), leaf)).cast("int") + 1
        first, last, low, high = (F.element_at(constant(a.tolist()), leaf) for a in (self.first, self.last, self.low, self.high))
        part = F.when(last > first, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - first) / (last - first)))).otherwise(0.0)
        return _or_zero(key, F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((low + part * (high - low)) * buckets))))


def constant(numbers: list[float]) -> Column:
    """An array of doubles as one literal, which the planner folds once: thousands of single literals take a second to build."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>") if numbers else F.array().cast("array<double>")


def _or_zero(key: str, bucket: Column) -> Column:
    """The bucket; 0 for a null key (greatest and least would pass over the null)."""
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(bucket).cast("int")


def train(sample, leaves: int = LEAVES) -> CdfModel:
    """A model of the sample's distribution. An empty leaf is flat at the level that the one before it reached."""
    keys = np.sort(np.asarray(sample, np.float64))
    if len(keys) == 0 or keys[0] == keys[-1]:
        at = float(keys[0]) if len(keys) else 0.0
        one = np.zeros(1)
        return CdfModel(at, at, one + at, one + at, one, one)
    model = CdfModel(float(keys[0]), float(keys[-1]), *(np.zeros(leaves) for _ in range(4)))
    place = model.leaf(keys)
    starts = np.searchsorted(place, np.arange(leaves), side="left")
    ends = np.searchsorted(place, np.arange(leaves), side="right")
    full = ends > starts
    model.first[full], model.last[full] = keys[starts[full]], keys[ends[full] - 1]
    model.low[:], model.high[:] = starts / len(keys), ends / len(keys)
    model.low[:] = np.maximum.accumulate(model.low)
    model.high[:] = np.maximum(model.low, np.maximum.accumulate(model.high))
    return model


def _drawn(keys: DataFrame, most: int) -> np.ndarray:
    drawn = F.xxhash64("k", F.monotonically_increasing_id())
    return keys.where("k is not null").select("k", drawn.alias("h")).orderBy("h").limit(most).select("k").toPandas()["k"].to_numpy(np.float64)


def sample_keys(df: DataFrame, key: str, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` keys in one pass, every row alike: each partition keeps its rows with the least hashes."""
    return _drawn(df.select(F.col(key).cast("double").alias("k")), most)


def sample_pair(left: DataFrame, right: DataFrame, key: str, most: int = SAMPLE) -> np.ndarray:
    """One sample of the rows of two sides, in one pass."""
    return _drawn(left.select(F.col(key).cast("double").alias("k")).unionAll(right.select(F.col(key).cast("double").alias("k"))), most)


def fit(df: DataFrame, key: str, leaves: int = LEAVES, **options) -> CdfModel:
    return train(sample_keys(df, key, **options), leaves)


def fit_pair(left: DataFrame, right: DataFrame, key: str, leaves: int = LEAVES, **options) -> CdfModel:
    """One model for both sides of a join."""
    return train(sample_pair(left, right, key, **options), leaves)


@dataclass
class SplineModel:
    """A CDF through a few knots, straight in between."""

    keys: np.ndarray
    levels: np.ndarray

    def cdf(self, keys) -> np.ndarray:
        return np.interp(np.asarray(keys, np.float64), self.keys, self.levels)

    def bucket(self, keys, buckets: int) -> np.ndarray:
        return np.clip(np.floor(self.cdf(keys) * buckets), 0, buckets - 1).astype(np.int64)

    def leaf_column(self, key: str, buckets: int) -> Column:
        """The bucket as a Column: the key's place among the boundaries between buckets, which are fixed by the knots."""
        if len(self.keys) < 2:
            return F.lit(0)
        levels = np.arange(1, buckets) / buckets
        bounds = np.interp(levels, self.levels, self.keys)
        above = F.filter(constant(bounds.tolist()), lambda b: b <= F.col(key).cast("double"))
        return _or_zero(key, F.size(above))


def train_spline(sample, error: float = 0.002, most: int = 4096) -> SplineModel:
    """Knots such that no sampled key's level is off by more than ``error``, taken greedily from the left; at most ``most``."""
    keys, first = np.unique(np.sort(np.asarray(sample, np.float64)), return_index=True)
    if len(keys) < 2:
        return SplineModel(keys if len(keys) else np.zeros(1), np.zeros(max(len(keys), 1)))
    levels = np.append(first[1:], len(sample)) / len(sample)
    levels = (levels - levels[0]) / (levels[-1] - levels[0])
    knots, at = [0], 0
    while at < len(keys) - 1 and len(knots) < most:
        reach = np.arange(at + 1, len(keys))
        rise = keys[reach] - keys[at]
        # slopes that keep every key passed so far within the error
        top = np.minimum.accumulate((levels[reach] + error - levels[at]) / rise)
        bottom = np.maximum.accumulate((levels[reach] - error - levels[at]) / rise)
        slope = (levels[reach] - levels[at]) / rise
        fine = np.flatnonzero((slope <= top) & (slope >= bottom) & (top >= bottom))
        at = int(reach[fine[-1]]) if len(fine) else at + 1
        knots.append(at)
    if knots[-1] != len(keys) - 1:
        knots.append(len(keys) - 1)
    return SplineModel(keys[knots], levels[knots])

"""Seeded generators of key relations (``key``, ``payload``), the same rows for the same seed.

Every random number is a hash of the row's index and the seed, so rows don't depend on how
they are partitioned, and a lost partition is made again as it was.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *more) -> Column:
    """A number in (0, 1) from a hash of ``id``, the seed and whatever else."""
    bits = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), *more), 11)
    return (bits.cast("double") + 0.5) * F.lit(2.0**-53)


def normal(seed: int) -> Column:
    """A standard normal number (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed))) * F.cos(2 * math.pi * uniform(seed + 1_000_003))


def _relation(rows: DataFrame, key: Column, payload: Column | None = None) -> DataFrame:
    keyed = rows.withColumn("key", key.cast("long"))
    return keyed.select("key", (F.col("key") if payload is None else payload).cast("long").alias("payload"))


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def shuffled(relation: DataFrame, seed: int) -> DataFrame:
    """The rows in an order that the seed decides."""
    return relation.orderBy(F.xxhash64("key", F.lit(seed)), "key")


def unique_dense(spark, n: int, payload: int | None = None) -> DataFrame:
    """Keys 1..n, each once; the payload is the key or a constant."""
    return _relation(_rows(spark, n), F.col("id") + 1, None if payload is None else F.lit(payload))


def sequential_with_holes(spark, n: int, seed: int = 1) -> DataFrame:
    """Exactly n of the keys 1..1.1n: of every eleven in a row, one that the seed picks is missing."""
    rows = _rows(spark, n + n // 10).withColumn("hole", F.pmod(F.xxhash64(F.expr("id div 11"), F.lit(seed)), F.lit(11)))
    whole = (n + n // 10) // 11 * 11  # fewer than eleven at the end all stay
    return _relation(rows.where((F.col("id") % 11 != F.col("hole")) | (F.col("id") >= whole)), F.col("id") + 1)


def unique_uniform(spark, n: int, seed: int = 1, bits: int = 32) -> DataFrame:
    """n distinct keys spread over 1..2**bits, by a permutation of the indexes: an odd multiplier modulo 2**bits."""
    half = bits // 2
    multiplier = (2 * (seed * 0x9E3779B1 % (1 << (half - 1))) + 1) % (1 << half)
    low = F.col("id").bitwiseAND((1 << half) - 1)
    high = F.shiftright("id", half)
    # two Feistel rounds: a bijection of pairs of halves
    for r in range(3):
        mixed = F.pmod(F.xxhash64(low, F.lit(seed * 31 + r)), F.lit(1 << half))
        low, high = high.bitwiseXOR(mixed), low
    return _relation(_rows(spark, n), high * (1 << half) + (low * multiplier) % (1 << half) + 1)


def foreign_keys(spark, n: int, greatest: int) -> DataFrame:
    """n rows that repeat the keys 1..greatest evenly."""
    return _relation(_rows(spark, n), F.col("id") % greatest + 1, F.col("id"))


def foreign_keys_of(keys: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows with keys of an existing relation: each row draws a rank."""
    from larkmill.functions.hashing import monotone_rank

    ranked = monotone_rank(keys, "key")
    size = ranked.count()
    drawn = _rows(keys.sparkSession, n).select(F.floor(uniform(seed) * max(size, 1)).alias("slot"), F.col("id").alias("payload"))
    return drawn.join(ranked, "slot").select("key", "payload")


def non_unique(spark, n: int, greatest: int, seed: int = 1) -> DataFrame:
    """n keys drawn from 1..greatest with replacement."""
    return _relation(_rows(spark, n), F.floor(uniform(seed) * greatest) + 1, F.col("id"))


def normal_keys(spark, n: int, mean: float, deviation: float, seed: int = 1) -> DataFrame:
    return _relation(_rows(spark, n), F.rint(normal(seed) * deviation + mean), F.col("id"))


def uniform_keys(spark, n: int, low: float, high: float, seed: int = 1) -> DataFrame:
    return _relation(_rows(spark, n), F.floor(uniform(seed) * (high - low) + low), F.col("id"))


def exponential_keys(spark, n: int, rate: float, scale: float, seed: int = 1) -> DataFrame:
    return _relation(_rows(spark, n), F.floor(-F.log(uniform(seed)) / rate * scale), F.col("id"))


def lognormal_keys(spark, n: int, mean: float, deviation: float, scale: float, seed: int = 1) -> DataFrame:
    return _relation(_rows(spark, n), F.floor(F.exp(normal(seed) * deviation + mean) * scale), F.col("id"))


def stepped(spark, n: int, step: int = 10, start: int = 20_000) -> DataFrame:
    """Keys start, start + step, ..."""
    return _relation(_rows(spark, n), F.col("id") * step + start)


def gapped(spark, n: int, gap: float = 0.1, seed: int = 1, parts: int = 64) -> DataFrame:
    """Ascending keys that skip one value with probability ``gap`` after each: running sums within parts, then over parts."""
    rows = _rows(spark, n).withColumn("step", F.when(uniform(seed) < gap, 2).otherwise(1)).withColumn("part", F.floor(F.col("id") * parts / max(n, 1)))
    inner = F.sum("step").over(Window.partitionBy("part").orderBy("id"))
    totals = rows.groupBy("part").agg(F.sum("step").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(totals.select("part", before.alias("base")))  # ``parts`` rows
    return rows.withColumn("inner", inner).join(base, "part").select((F.col("base") + F.col("inner")).alias("key"), F.col("id").alias("payload"))


def wide_uniform(spark, n: int, seed: int = 1) -> DataFrame:
    """Keys in 0..2**40."""
    return uniform_keys(spark, n, 0, float(1 << 40), seed)


def wide_normal(spark, n: int, seed: int = 1, mean: float = 100.0, deviation: float = 20.0) -> DataFrame:
    """A normal distribution cut at three deviations and stretched over 0..2**40."""
    cut = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), normal(seed)))
    return _relation(_rows(spark, n), F.floor((cut * deviation + 3 * deviation) / (6 * deviation) * float(1 << 40)), F.col("id"))


def window_of(relation: DataFrame, low: int, high: int) -> DataFrame:
    """The keys in [low, high), shifted to start at 0."""
    return relation.where((F.col("key") >= low) & (F.col("key") < high)).withColumn("key", F.col("key") - low)


def zipf(spark, n: int, alphabet: int, exponent: float, seed: int = 1) -> DataFrame:
    """n keys of 1..alphabet by Zipf's law over a permuted alphabet: a uniform number is looked up in the cumulative weights.

    The distribution function is inverted in closed form for its tail (ranks over 1000), so the
    table that is looked up has a fixed size.
    """
    head = min(alphabet, 1000)
    weights = [k**-exponent for k in range(1, head + 1)]
    # the tail's mass and inverse by the integral of x**-exponent from head + 1/2 to alphabet + 1/2
    low, high = head + 0.5, alphabet + 0.5
    if alphabet <= head:
        tail = 0.0
    elif abs(exponent - 1) < 1e-9:
        tail = math.log(high / low)
    else:
        tail = (high ** (1 - exponent) - low ** (1 - exponent)) / (1 - exponent)
    total = sum(weights) + tail
    ends, run = [], 0.0
    for w in weights:
        run += w / total
        ends.append(run)
    u = F.col("u")
    in_head = F.array_position(F.transform(F.lit(ends), lambda e: u < e), F.lit(True))
    v = (u - ends[-1]) * total
    if abs(exponent - 1) < 1e-9:
        deep = F.lit(low) * F.exp(v)
    else:
        deep = F.pow(F.lit(low ** (1 - exponent)) + v * (1 - exponent), F.lit(1 / (1 - exponent)))
    rank = F.when(in_head > 0, in_head).otherwise(F.least(F.lit(alphabet), F.rint(deep))).cast("long")
    step = next(s for s in range(alphabet // 2 + 1, 2 * alphabet + 2) if math.gcd(s, alphabet) == 1)
    permuted = (rank * step + seed) % alphabet + 1
    return _rows(spark, n).withColumn("u", uniform(seed)).select(permuted.alias("key"), F.col("id").alias("payload"))


def from_keys(keys: DataFrame, key: str) -> DataFrame:
    """A relation of an existing key column."""
    return keys.select(F.col(key).cast("long").alias("key"), F.col(key).cast("long").alias("payload"))


def downsampled(relation: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th of the sorted distinct keys, for training a model."""
    from larkmill.functions.hashing import monotone_rank

    return monotone_rank(relation, "key").where(F.col("slot") % every == 0).select("key")

"""Equi-joins under interchangeable physical strategies; all return the same rows.

``auto`` leaves the choice to the planner and its adaptive re-planning; the others force one
strategy, for comparison or because the data are known. ``broadcast`` counts the right
side's rows and bytes first and falls back to a shuffle beyond ``BROADCAST_BYTES``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

from larkmill.functions import models

STRATEGIES = ("auto", "broadcast", "shuffle_hash", "merge", "radix", "range", "salted", "learned_hash", "learned_two_level", "learned_spline", "learned_partitioned")
#: The largest side, by its rows as they lie in memory, that is sent to every executor.
BROADCAST_BYTES = 64 << 20
SALTS = 16
#: A key is heavy if it has more than this share of a partition's fair share of rows.
HEAVY_SHARE = 4.0
#: Heavy keys of a range join that are treated apart, at most.
HEAVY_RANGES = 16
#: Heavy keys that are treated apart, at most; further ones are joined as usual.
HEAVY_KEYS = 1000


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows in memory: Spark's estimate follows the files, whose rows are encoded and compressed."""
    fixed, varying = 8 * (1 + len(df.columns)), F.lit(0)
    for field in df.schema.fields:
        if not isinstance(field.dataType, (NumericType, BooleanType, DatetimeType)):
            varying = varying + F.coalesce(F.octet_length(F.col(f"`{field.name}`").cast("string")), F.lit(0))
    return df.agg(F.sum(F.lit(fixed) + varying)).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def equi_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", strategy: str = "auto", **options) -> DataFrame:
    """``left`` joined with ``right`` on equal columns ``on``; ``how``: inner or left_semi.

    Inner joins return every pair (all duplicates), semi joins each left row at most once.
    Null keys match nothing. Other columns of the two sides must have different names.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"how: {how}")
    if strategy == "auto":
        return left.join(right, on, how)
    if strategy == "broadcast":
        fits = estimated_bytes(right) <= BROADCAST_BYTES and measured_bytes(right) <= BROADCAST_BYTES
        return left.join(F.broadcast(right) if fits else right.hint("merge"), on, how)
    if strategy == "shuffle_hash":
        return left.join(right.hint("shuffle_hash"), on, how)
    if strategy == "merge":
        return left.join(right.hint("merge"), on, how)
    if strategy == "radix":
        return radix_join(left, right, on, how, **options)
    if strategy == "range":
        return range_join(left, right, on, how, **options)
    if strategy == "salted":
        return salted_join(left, right, on, how, **options)
    if strategy in ("learned_hash", "learned_two_level"):
        return learned_hash_join(left, right, on, how, two_level=strategy == "learned_two_level", **options)
    if strategy == "learned_spline":
        key, = on
        spline = models.train_spline(models.sample_pair(left, right, key))
        return learned_hash_join(left, right, on, how, two_level=True, model=spline, **options)
    if strategy == "learned_partitioned":
        return learned_partitioned_join(left, right, on, how, **options)
    raise ValueError(f"strategy: {strategy}")


def radix_join(left, right, on, how="inner", bits: int = 6, passes: int = 1):
    """Both sides dealt to 2**bits parts by the lowest bits of their keys' hash, which are joined by hash tables.

    With two passes each part is clustered by the next bits, and joined cluster by cluster.
    """
    n = 1 << bits
    if passes == 1:
        return left.repartition(n, *on).join(right.repartition(n, *on).hint("shuffle_hash"), on, how)
    if passes != 2:
        raise ValueError(f"passes: {passes}")
    hashed = F.xxhash64(*on)

    def clustered(df):
        df = df.dropna(subset=on)
        placed = df.withColumn("radix_part", F.pmod(hashed, F.lit(n)).cast("int")).withColumn("radix_cluster", F.pmod(F.shiftright(hashed, bits), F.lit(n)).cast("int"))
        return placed.repartitionById(n, "radix_part")

    return clustered(left).join(clustered(right).hint("merge"), ["radix_part", "radix_cluster", *on], how).drop("radix_part", "radix_cluster")


def equi_depth(left, right, key: str, parts: int) -> tuple[list[float], list[float]]:
    """Bounds between ``parts`` ranges of about equally many rows of both sides, and the keys that fill more than one range."""
    sample = np.sort(models.sample_pair(left, right, key))
    if not len(sample):
        return [], []
    bounds = sample[(np.arange(1, parts) * len(sample)) // parts]
    value, times = np.unique(sample, return_counts=True)
    heavy = value[times > 2 * len(sample) / parts]
    return np.unique(bounds).tolist(), heavy[np.argsort(-times[times > 2 * len(sample) / parts], kind="stable")][:HEAVY_RANGES].tolist()


def range_of(key: str, bounds: list[float]) -> Column:
    """The range of a key: how many bounds are not above it. Every 32nd bound is looked at first, then the 32 from there."""
    if not bounds:
        return F.lit(0)
    value, every = F.col(key).cast("double"), models.constant(bounds)
    coarse = F.size(F.filter(models.constant(bounds[31::32]), lambda b: b <= value)) * 32 if len(bounds) > 32 else F.lit(0)
    fine = F.size(F.filter(F.slice(every, coarse + 1, F.lit(32)), lambda b: b <= value))
    return (coarse + fine).cast("int")


def range_join(left, right, on, how="inner", parts: int | None = None, salts: int = SALTS):
    """Both sides go to the same equi-depth ranges of the key, one shuffle each, are sorted there and merged.

    Bounds come from one sample of both sides. Rows of ``left`` with a key that fills more than
    one range by itself are dealt to ``salts`` parts, and those of ``right`` repeated there.
    """
    key = on[0]
    parts = parts or partitions(left.sparkSession)
    bounds, heavy = equi_depth(left, right, key, parts)
    is_heavy = F.col(key).cast("double").isin(heavy) if heavy else F.lit(False)

    def placed(df, salt: Column):
        rows = df.dropna(subset=on).withColumn("range_salt", salt).withColumn("range_no", range_of(key, bounds))
        # the salts of one range lie apart
        return rows.withColumn("range_part", F.pmod(F.col("range_no") + F.col("range_salt") * F.lit(max(1, parts // salts)), F.lit(parts)).cast("int")).drop("range_no").repartitionById(parts, "range_part")

    dealt = F.when(is_heavy, F.pmod(F.xxhash64(*left.columns, F.lit(1)), F.lit(salts))).otherwise(0).cast("int")
    repeated = F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))) if heavy else F.lit(0)
    return placed(left, dealt).join(placed(right, repeated).hint("merge"), ["range_part", "range_salt", *on], how).drop("range_part", "range_salt")


def heavy_keys(df: DataFrame, on: list[str], parts: int, share: float = HEAVY_SHARE, limit: int = HEAVY_KEYS) -> DataFrame:
    """The keys with more rows than ``share`` fair shares of a partition: at most ``limit``, largest first."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows_of_key"))
    total = df.count()
    return counts.where(F.col("rows_of_key") > share * total / parts).orderBy(F.desc("rows_of_key"), *on).limit(limit).select(*on)


def salted_join(left, right, on, how="inner", salts: int = SALTS, parts: int | None = None, share: float = HEAVY_SHARE):
    """Rows of heavy keys of ``left`` are dealt to ``salts`` parts; only the matching rows of ``right`` are repeated."""
    parts = parts or partitions(left.sparkSession)
    heavy = F.broadcast(heavy_keys(left, on, parts, share).withColumn("is_heavy", F.lit(True)))
    rows = left.join(heavy, on, "left")
    # by the row's own columns: a task that runs again deals them alike (rows that are equal in all columns stay together)
    spread = F.when(F.col("is_heavy"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(0).cast("int")
    rows = rows.withColumn("salt", spread).drop("is_heavy")
    copies = F.when(F.col("is_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(heavy, on, "left").withColumn("salt", F.explode(copies)).drop("is_heavy")
    return rows.join(repeated.hint("merge"), [*on, "salt"], how).drop("salt")


def learned_hash_join(left, right, on, how="inner", two_level=False, buckets: int | None = None, model=None):
    """The bucket of a key is its place in the learned distribution; sides join on (bucket, key)."""
    key, = on
    buckets = buckets or partitions(left.sparkSession)
    model = model or models.fit_pair(left, right, key)
    place: Column = model.leaf_column(key, buckets) if two_level else model.column(key, buckets)
    joined = left.withColumn("bucket", place).join(right.withColumn("bucket", place).hint("shuffle_hash"), ["bucket", key], how)
    return joined.drop("bucket")


def learned_partitioned_join(left, right, on, how="inner", buckets: int | None = None, model=None):
    """Both sides go to the partition that the learned distribution names, are sorted there and merged: one shuffle each."""
    key, = on
    buckets = buckets or partitions(left.sparkSession)
    model = model or models.fit_pair(left, right, key)
    place = model.leaf_column(key, buckets)

    def placed(df):
        return df.where(F.col(key).isNotNull()).withColumn("bucket", place).repartitionById(buckets, "bucket")

    return placed(left).join(placed(right).hint("merge"), ["bucket", key], how).drop("bucket")


def match_count(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", strategy: str = "auto", **options) -> DataFrame:
    """One row, ``matches``: the size of the join."""
    return equi_join(left.select(*on), right.select(*on), on, how, strategy, **options).agg(F.count(F.lit(1)).alias("matches"))


def matches_by_partition(joined: DataFrame) -> DataFrame:
    """How the join's rows are spread over tasks."""
    return joined.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("matches"))

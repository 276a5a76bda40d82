"""Global sorts: by sampled ranges, and by a learned distribution of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkmill.functions import models

from .joins import partitions


def range_sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def top(df: DataFrame, n: int, *keys) -> DataFrame:
    """The first ``n`` rows by ``keys``: each partition keeps n."""
    return df.orderBy(*keys).limit(n)


def learned_sort(df: DataFrame, key: str, *more: str, buckets: int | None = None, model=None) -> DataFrame:
    """Rows in partitions that ascend in ``key``, each sorted: in partition order the result is globally sorted.

    Buckets are monotone in the key, so only a bucket's own rows are sorted together. Nulls come first.
    """
    buckets = buckets or partitions(df.sparkSession)
    model = model or models.fit(df, key)
    place = F.coalesce(model.leaf_column(key, buckets), F.lit(0))
    return df.withColumn("bucket", place).repartitionById(buckets, "bucket").drop("bucket").sortWithinPartitions(F.col(key).asc_nulls_first(), *more)


def positions(df: DataFrame, key: str, *more: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``position``: each row's place (from 0) in the learned sort's order, without a task that holds all rows."""
    buckets = buckets or partitions(df.sparkSession)
    model = models.fit(df, key)
    placed = df.withColumn("bucket", F.coalesce(model.leaf_column(key, buckets), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col(key).asc_nulls_first(), *more))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows_of_bucket"))
    before = F.coalesce(F.sum("rows_of_bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(sizes.select("bucket", before.alias("base")))  # one row for each bucket
    return placed.withColumn("local", within).join(base, "bucket").withColumn("position", (F.col("base") + F.col("local") - 1).cast("long")).drop("bucket", "local", "base")

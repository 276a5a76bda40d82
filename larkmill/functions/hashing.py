"""Hash functions of keys and their reduction to buckets, all as JVM-side expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A fixed odd multiplier below 2**31 for multiplicative hashing of 31-bit values.
MULTIPLIER = 1_103_515_245


def murmur(*keys: str) -> Column:
    return F.hash(*keys)


def xx(*keys: str) -> Column:
    return F.xxhash64(*keys)


def crc(*keys: str) -> Column:
    return F.crc32(F.concat_ws("|", *keys).cast("binary"))


def multiplicative(key: str, bits: int = 16) -> Column:
    """The top ``bits`` of the low 31 bits of key * MULTIPLIER."""
    low = F.col(key).bitwiseAND(0x7FFFFFFF)
    product = (low.bitwiseAND(0xFFFF) * MULTIPLIER + (F.shiftright(low, 16) * MULTIPLIER).bitwiseAND(0x7FFF) * 65536).bitwiseAND(0x7FFFFFFF)
    return F.shiftright(product, 31 - bits).cast("int")


def bucket(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets)).cast("int")


def combine(*hashes: Column) -> Column:
    """Several columns' hashes in one, order included."""
    return reduce(lambda a, b: F.xxhash64(a, b), hashes)


SCHEMES = {"murmur": murmur, "xxhash": xx, "crc32": crc}


def scheme_report(df: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """How each scheme spreads the distinct keys: ``scheme, keys, used`` buckets and the ``fullest`` one."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    schemes = F.array(*(F.struct(F.lit(name).alias("scheme"), bucket(hashed(key), buckets).alias("bucket")) for name, hashed in sorted(SCHEMES.items())))
    loads = keys.select(F.explode(schemes).alias("s")).groupBy("s.scheme", "s.bucket").agg(F.count(F.lit(1)).alias("n"))
    return loads.groupBy("scheme").agg(F.sum("n").alias("keys"), F.count(F.lit(1)).alias("used"), F.max("n").alias("fullest"))


def occupancy(df: DataFrame, bucket_column: Column) -> DataFrame:
    """How full the buckets of a hash table would be: ``load, buckets, keys``."""
    loads = df.groupBy(bucket_column.alias("bucket")).agg(F.count(F.lit(1)).alias("load"))
    return loads.groupBy("load").agg(F.count(F.lit(1)).alias("buckets"), F.sum("load").alias("keys"))


def monotone_rank(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """A minimal perfect, monotone hash: each distinct key's rank from 0. Range partitions count first, so no task sorts all."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(key).alias("key")).where("key is not null").distinct()
    placed = keys.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id())
    from pyspark.sql import Window

    local = placed.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy("key")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("part", before.alias("base"))  # one row for each partition
    return local.join(F.broadcast(base), "part").select("key", (F.col("base") + F.col("local") - 1).cast("long").alias("slot"))

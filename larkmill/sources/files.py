"""Readers and writers: delimited tables, key relations as text, binary key files, metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.session import ship

# Column names and types of the benchmark tables' delimited files, in file order.
TPCH = {
    "part": "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice decimal(12,2), p_comment string",
    "supplier": "s_suppkey long, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal decimal(12,2), s_comment string",
    "partsupp": "ps_partkey long, ps_suppkey long, ps_availqty int, ps_supplycost decimal(12,2), ps_comment string",
    "customer": "c_custkey long, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal decimal(12,2), c_mktsegment string, c_comment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice decimal(12,2), o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity decimal(12,2), l_extendedprice decimal(12,2), l_discount decimal(12,2), l_tax decimal(12,2), l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
}
SSB = {
    "lineorder": "lo_orderkey int, lo_linenumber int, lo_custkey int, lo_partkey int, lo_suppkey int, lo_orderdate int, lo_orderpriority string, lo_shippriority string, lo_quantity int, lo_extendedprice decimal(18,2), lo_ordtotalprice decimal(18,2), lo_discount decimal(18,2), lo_revenue decimal(18,2), lo_supplycost decimal(18,2), lo_tax int, lo_commitdate int, lo_shopmode string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_category string, p_brand1 string, p_color string, p_type string, p_size int, p_container string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_city string, s_nation string, s_region string, s_phone string",
    "customer": "c_custkey int, c_name string, c_address string, c_city string, c_nation string, c_region string, c_phone string, c_mktsegment string",
    "date": "d_datekey int, d_date string, d_dayofweek string, d_month string, d_year int, d_yearmonthnum int, d_yearmonth string, d_daynuminweek int, d_daynuminmonth int, d_daynuminyear int, d_monthnuminyear int, d_weeknuminyear int, d_sellingseasin string, d_lastdayinweekfl int, d_lastdayinmonthfl int, d_holidayfl int, d_weekdayfl int",
}


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = "|") -> DataFrame:
    """Rows of ``.tbl`` files; a separator at the line's end is no column, blanks around numbers don't matter."""
    return spark.read.option("sep", separator).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def write_delimited(df: DataFrame, path: str, separator: str = "|") -> None:
    df.write.mode("overwrite").option("sep", separator).csv(path)


def import_tables(spark: SparkSession, folder: str, schemas: dict[str, str] = TPCH, *, cache: str | None = None, register: bool = True) -> dict[str, DataFrame]:
    """Delimited tables ``folder/<name>.tbl`` by name; with ``cache`` they are converted to Parquet once and read from there."""
    out = {}
    for name, schema in schemas.items():
        df = read_delimited(spark, f"{folder}/{name}.tbl", schema)
        if cache:
            df.write.mode("ignore").parquet(f"{cache}/{name}.parquet")
            df = spark.read.parquet(f"{cache}/{name}.parquet")
        if register:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``column, <column>_id``: distinct values numbered from 0 in their order."""
    from larkmill.functions.hashing import monotone_rank

    return monotone_rank(df, column).select(F.col("key").alias(column), F.col("slot").alias(f"{column}_id"))


def encoded(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with an id column beside each of the given string columns."""
    for c in columns:
        df = df.join(dictionary(df, c), c, "left")
    return df


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """Text relations: ``key payload`` or ``key`` a line, under an optional header that starts with ``#``."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"[ ,]+")
    return lines.select(parts[0].cast("long").alias("key"), F.coalesce(F.try_element_at(parts, F.lit(2)).cast("long"), parts[0].cast("long")).alias("payload"))


def write_relation(relation: DataFrame, path: str, files: int | None = None) -> None:
    """``key payload`` lines in as many files as there are partitions, or ``files``."""
    rows = relation.repartition(files) if files else relation
    rows.select(F.concat_ws(" ", "key", "payload").alias("value")).write.mode("overwrite").text(path)


def materialize_keys(df: DataFrame, key: str, path: str) -> DataFrame:
    """A query's key list, written as a relation for later joins, sorted within files by range."""
    keys = df.select(F.col(key).cast("long").alias("key")).sort("key")
    keys.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes of a key file that one task reads.
SPLIT_BYTES = 64 << 20


def read_binary_keys(spark: SparkSession, path: str, *, width: int = 8, distinct: bool = False, payload_shift: int = 5, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Files of a 64-bit count and then little-endian unsigned keys of ``width`` bytes; the payload is key - ``payload_shift``.

    Files are read as records of fixed size, by ranges of bytes, so a file of any size is many
    tasks' work. Keys are decimals, as those beyond 2**63 - 1 don't fit a long. ``distinct``
    drops repeated keys and sorts.
    """
    ship(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    files = [f.getPath().toString() for f in system.globStatus(place) for f in (system.listStatus(f.getPath()) if f.isDirectory() else [f])]
    head = 8 // width  # records that the count takes
    parts = []
    for file in sorted(files):
        lines = spark.sparkContext.newAPIHadoopFile(file, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(width), "mapreduce.input.fileinputformat.split.maxsize": str(split_bytes)})
        parts.append(lines.filter(lambda r: r[0] >= head * width).map(lambda r: (bytes(r[1]),)))
    schema = T.StructType([T.StructField("raw", T.BinaryType())])
    raw = spark.createDataFrame(spark.sparkContext.union(parts) if parts else spark.sparkContext.emptyRDD(), schema)
    # the bytes from the last to the first, as hexadecimal digits of a number
    digits = F.concat(*(F.hex(F.substring("raw", k, 1)) for k in range(width, 0, -1)))
    rows = raw.select(F.conv(digits, 16, 10).cast("decimal(20,0)").alias("key"))
    if distinct:
        rows = rows.distinct().sort("key")
    return rows.withColumn("payload", (F.col("key") - payload_shift).cast("decimal(20,0)"))


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file by Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(conf).create(place, True)
    out.write(bytearray(content))
    out.close()


def binary_keys(keys, width: int = 8) -> bytes:
    """The content of a binary key file."""
    array = np.asarray(keys, f"<u{width}")
    return np.array([len(array)], "<u8").tobytes() + array.tobytes()


def write_metrics(path: str, columns: dict[str, list]) -> None:
    """Benchmark figures as CSV, one column for each name."""
    import csv

    with open(path, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(columns)
        writer.writerows(zip(*columns.values()))


def read_metrics(path: str) -> dict[str, list[str]]:
    import csv

    with open(path, newline="") as source:
        rows = list(csv.reader(source))
    return {name: [r[i] for r in rows[1:]] for i, name in enumerate(rows[0])} if rows else {}

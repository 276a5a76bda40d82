"""Tables and derived star-schema views over a folder of Parquet files.

Every view is a lazy DataFrame: filters and column selections made on it reach the scans.
Money is handled in whole cents and discounts in whole percents (BIGINT), so sums are exact
whatever the order of rows; results are divided once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Catalog:
    """Tables of one folder, by attribute: ``Catalog(spark, dir).lineitem``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in _VIEWS:
            return _VIEWS[name](self)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def register(self, names=TABLES) -> None:
        """Make tables and derived views known to ``spark.sql``."""
        for name in (*names, *_VIEWS):
            getattr(self, name).createOrReplaceTempView(name)


def day(text: str) -> Column:
    """A timestamp literal of the tables' own type, so that comparisons are pushed to the scan."""
    return F.expr(f"TIMESTAMP_NTZ '{text} 00:00:00'")


def cents(column: str) -> Column:
    return F.expr(f"CAST(round({column} * 100) AS BIGINT)")


def exact_sum(value: Column) -> Column:
    """A sum of whole numbers that can't overflow a long: of their upper and lower parts, put together once."""
    whole = value.cast("long")
    upper, lower = F.sum(F.shiftright(whole, 24)), F.sum(whole.bitwiseAND((1 << 24) - 1))
    return (upper.cast("decimal(28,0)") * F.lit(1 << 24).cast("decimal(8,0)") + lower.cast("decimal(28,0)")).cast("double")


def supply_cost(part: str, supplier: str) -> Column:
    """The supply cost in cents that stands in for a missing table: a fixed function of the two keys."""
    return F.expr(f"100 + ({part} * 7 + {supplier} * 13) % 90000")


def _partsupp(c: Catalog) -> DataFrame:
    keys = c.lineitem.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    return keys.withColumn("ps_supplycost", supply_cost("ps_partkey", "ps_suppkey"))


def _date_key(column: str) -> Column:
    return F.expr(f"CAST(year({column}) * 10000 + month({column}) * 100 + day({column}) AS BIGINT)")


def _lineorder(c: Catalog) -> DataFrame:
    orders = c.orders.select("o_orderkey", "o_custkey", _date_key("o_orderdate").alias("lo_orderdate"))
    lines = c.lineitem.select(
        F.col("l_orderkey").alias("lo_orderkey"),
        F.col("l_linenumber").alias("lo_linenumber"),
        F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"),
        F.expr("CAST(l_quantity AS BIGINT)").alias("lo_quantity"),
        cents("l_extendedprice").alias("lo_extendedprice"),
        cents("l_discount").alias("lo_discount"),
        (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("lo_revenue"),
        (supply_cost("l_partkey", "l_suppkey") * 100).alias("lo_supplycost"),
    )
    return lines.join(orders, F.col("lo_orderkey") == F.col("o_orderkey")).drop("o_orderkey").withColumnRenamed("o_custkey", "lo_custkey")


def _date(c: Catalog) -> DataFrame:
    d = "o_orderdate"
    return c.orders.select(
        _date_key(d).alias("d_datekey"),
        F.expr(f"CAST(year({d}) AS INT)").alias("d_year"),
        F.expr(f"CAST(year({d}) * 100 + month({d}) AS INT)").alias("d_yearmonthnum"),
        F.date_format(d, "MMMyyyy").alias("d_yearmonth"),
        F.expr(f"CAST((dayofyear({d}) - 1) DIV 7 + 1 AS INT)").alias("d_weeknuminyear"),
    ).distinct()


def _party(c: Catalog, table: DataFrame, p: str, key: str) -> DataFrame:
    """A customer or supplier dimension with city, nation and region names."""
    nations = c.nation.join(c.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return table.join(F.broadcast(nations), F.col(f"{p}_nationkey") == F.col("n_nationkey")).select(
        F.col(key),
        F.concat("n_name", F.lit(" "), (F.col(key) % 10).cast("string")).alias(f"{p}_city"),
        F.col("n_name").alias(f"{p}_nation"),
        F.col("r_name").alias(f"{p}_region"),
    )


def _ssb_part(c: Catalog) -> DataFrame:
    number = F.expr("CAST(substring(p_brand, 7) AS INT)")
    return c.part.select("p_partkey", F.col("p_brand").alias("p_brand1"), F.col("p_type").alias("p_category"), F.concat(F.lit("MFGR#"), ((number - 1) % 5 + 1).cast("string")).alias("p_mfgr"))


_VIEWS = {
    "partsupp": _partsupp,
    "lineorder": _lineorder,
    "date": _date,
    "ssb_customer": lambda c: _party(c, c.customer, "c", "c_custkey"),
    "ssb_supplier": lambda c: _party(c, c.supplier, "s", "s_suppkey"),
    "ssb_part": _ssb_part,
}

#: The same views for an SQL engine that has the base tables.
VIEW_SQL = {
    "partsupp": "SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, 100 + (l_partkey * 7 + l_suppkey * 13) % 90000 AS ps_supplycost FROM lineitem",
    "lineorder": """SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey, o_custkey AS lo_custkey,
        CAST(l_quantity AS BIGINT) AS lo_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice, CAST(round(l_discount * 100) AS BIGINT) AS lo_discount,
        CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS lo_revenue,
        (100 + (l_partkey * 7 + l_suppkey * 13) % 90000) * 100 AS lo_supplycost,
        year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS lo_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "dates": """SELECT DISTINCT year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS d_datekey, CAST(year(o_orderdate) AS INT) AS d_year,
        CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS d_yearmonthnum, strftime(o_orderdate, '%b%Y') AS d_yearmonth,
        CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INT) AS d_weeknuminyear FROM orders""",
    "ssb_customer": "SELECT c_custkey, n_name || ' ' || CAST(c_custkey % 10 AS VARCHAR) AS c_city, n_name AS c_nation, r_name AS c_region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "ssb_supplier": "SELECT s_suppkey, n_name || ' ' || CAST(s_suppkey % 10 AS VARCHAR) AS s_city, n_name AS s_nation, r_name AS s_region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "ssb_part": "SELECT p_partkey, p_brand AS p_brand1, p_type AS p_category, 'MFGR#' || CAST((CAST(substring(p_brand, 7) AS INT) - 1) % 5 + 1 AS VARCHAR) AS p_mfgr FROM part",
}


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names) + "\n" + sql

"""TPC-H queries 1, 3, 5, 6, 9 and 18 with their parts, adapted to the tables at hand.

Orders start in 1995, so queries 5 and 6 take that year; query 6 over 1994 is kept as the
case without input rows. ``partsupp`` is derived, and query 9 asks for parts named "red".
Dimension tables are left to the planner, which broadcasts them if their size allows it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.catalog import cents, day, exact_sum, with_views
from larkmill.operators.aggregates import having

from .registry import query

_P, _D, _T = (f"CAST(round({c} * 100) AS BIGINT)" for c in ("l_extendedprice", "l_discount", "l_tax"))


def revenue():
    """Price times (1 - discount), in units of 1/10000."""
    return cents("l_extendedprice") * (100 - cents("l_discount"))


_REVENUE = f"CAST(sum({_P} * (100 - {_D})) AS DOUBLE) / 10000"


@query(
    "tpch_q1",
    f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS sum_qty, CAST(sum({_P}) AS DOUBLE) / 100 AS sum_base_price,
    {_REVENUE} AS sum_disc_price, CAST(sum({_P} * (100 - {_D}) * (100 + {_T})) AS DOUBLE) / 1000000 AS sum_charge,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_qty, CAST(sum({_P}) AS DOUBLE) / 100 / count(*) AS avg_price,
    CAST(sum({_D}) AS DOUBLE) / 100 / count(*) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def q1(c):
    lines = c.lineitem.where(F.col("l_shipdate") <= day("1998-09-02"))
    lines = lines.select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"), cents("l_extendedprice").alias("p"), cents("l_discount").alias("d"), cents("l_tax").alias("t"))
    lines = lines.withColumn("r", F.col("p") * (100 - F.col("d")))
    n = F.count(F.lit(1))
    total = {k: exact_sum(F.col(k)) for k in "qpdr"}
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        total["q"].alias("sum_qty"),
        (total["p"] / 100).alias("sum_base_price"),
        (total["r"] / 10000).alias("sum_disc_price"),
        (exact_sum(F.col("r") * (100 + F.col("t"))) / 1000000).alias("sum_charge"),
        (total["q"] / n).alias("avg_qty"),
        (total["p"] / 100 / n).alias("avg_price"),
        (total["d"] / 100 / n).alias("avg_disc"),
        n.alias("count_order"),
    )


@query(
    "tpch_q3",
    f"""SELECT l_orderkey, o_orderdate, {_REVENUE} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate""",
)
def q3(c):
    customers = c.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = q3_orders(c).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = c.lineitem.where(F.col("l_shipdate") > day("1995-03-15")).select("l_orderkey", revenue().alias("r"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg((exact_sum(F.col("r")) / 10000).alias("revenue"))


@query("tpch_q3_orders", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-15'")
def q3_orders(c):
    return c.orders.where(F.col("o_orderdate") < day("1995-03-15")).select("o_orderkey", "o_custkey", "o_orderdate")


def _q5(c, region, year):
    nations = c.nation.join(c.region, F.col("n_regionkey") == F.col("r_regionkey"))
    orders = c.orders
    if region:
        nations = nations.where(F.col("r_name") == region)
    if year:
        orders = orders.where((F.col("o_orderdate") >= day(f"{year}-01-01")) & (F.col("o_orderdate") < day(f"{year + 1}-01-01")))
    customers = c.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    ours = orders.select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = c.lineitem.select("l_orderkey", "l_suppkey", revenue().alias("r")).join(ours, F.col("l_orderkey") == F.col("o_orderkey"))
    suppliers = c.supplier.select("s_suppkey", "s_nationkey")
    same = (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    return lines.join(suppliers, same).groupBy("n_name").agg((exact_sum(F.col("r")) / 10000).alias("revenue"))


_Q5 = f"""SELECT n_name, {_REVENUE} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey {{}} GROUP BY n_name"""


@query("tpch_q5", _Q5.format("WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"))
def q5(c):
    return _q5(c, "ASIA", 1995)


@query("tpch_q5_nosel", _Q5.format(""))
def q5_nosel(c):
    return _q5(c, None, None)


@query("tpch_q5_customer_nations", "SELECT c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def q5_customers(c):
    nations = c.nation.join(c.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey")


def _q6(c, year):
    lines = c.lineitem.where((F.col("l_shipdate") >= day(f"{year}-01-01")) & (F.col("l_shipdate") < day(f"{year + 1}-01-01")))
    lines = lines.where("l_discount >= 0.045 AND l_discount <= 0.075 AND l_quantity < 24")
    return lines.agg((exact_sum(cents("l_extendedprice") * cents("l_discount")) / 10000).alias("revenue"))


_Q6 = f"""SELECT CAST(sum({_P} * {_D}) AS DOUBLE) / 10000 AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '{{0}}-01-01' AND l_shipdate < TIMESTAMP '{{1}}-01-01'
    AND l_discount >= 0.045 AND l_discount <= 0.075 AND l_quantity < 24"""


@query("tpch_q6", _Q6.format(1995, 1996))
def q6(c):
    """Discounts of 5 to 7 percent, asked for in halves so that binary fractions don't matter."""
    return _q6(c, 1995)


@query("tpch_q6_empty", _Q6.format(1994, 1995))
def q6_empty(c):
    """No row qualifies: SQL's one row with a null sum."""
    return _q6(c, 1994)


@query(
    "tpch_q9",
    with_views(
        f"""SELECT n_name, CAST(year(o_orderdate) AS INT) AS o_year, CAST(sum({_P} * (100 - {_D}) - ps_supplycost * 100 * CAST(l_quantity AS BIGINT)) AS DOUBLE) / 10000 AS profit
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN partsupp ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey WHERE p_name LIKE '%red%' GROUP BY 1, 2""",
        "partsupp",
    ),
)
def q9(c):
    parts = c.part.where(F.col("p_name").contains("red")).select("p_partkey")
    suppliers = c.supplier.join(c.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    supply = c.partsupp.join(parts, F.col("ps_partkey") == F.col("p_partkey"), "left_semi")  # bushy: joined before it meets lines
    lines = c.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), revenue().alias("r"))
    lines = lines.join(supply, (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey")))
    lines = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    orders = c.orders.select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    gain = F.col("r") - F.col("ps_supplycost") * 100 * F.col("q")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name", "o_year").agg((exact_sum(gain) / 10000).alias("profit"))


@query("tpch_q9_suppkeys", "SELECT DISTINCT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%red%'")
def q9_suppkeys(c):
    parts = c.part.where(F.col("p_name").contains("red")).select("p_partkey")
    return c.lineitem.select("l_partkey", "l_suppkey").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_suppkey").distinct()


_BIG = "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS sum_qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300"


@query("tpch_q18_group", _BIG)
def q18_group(c):
    return having(c.lineitem.select("l_orderkey", F.col("l_quantity").cast("long").alias("q")), ["l_orderkey"], {"sum_qty": exact_sum(F.col("q"))}, F.col("sum_qty") > 300)


@query("tpch_q18_orderkeys", f"SELECT l_orderkey FROM ({_BIG})")
def q18_orderkeys(c):
    return q18_group(c).select("l_orderkey")


@query(
    "tpch_q18",
    f"""SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS sum_qty
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM ({_BIG})) GROUP BY 1, 2, 3, 4, 5""",
)
def q18(c):
    """The group by order key is the sum wanted: it joins orders directly, without reading lines again."""
    orders = c.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(q18_group(c), F.col("o_orderkey") == F.col("l_orderkey"))
    joined = orders.join(c.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice").agg(F.sum("sum_qty").alias("sum_qty"))

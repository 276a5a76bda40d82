"""Small queries, one for each selection, projection, aggregate, join strategy, sort and index."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.catalog import cents, day, exact_sum
from larkmill.functions import hashing
from larkmill.operators import aggregates, filters, index, joins, projections, sorting
from larkmill.sources import generators

from .registry import query

# selections
_SYMBOL = {"eq": "=", "ge": ">=", "gt": ">", "le": "<=", "lt": "<"}
for _how, _sign in _SYMBOL.items():
    query(f"filter_cmp_{_how}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sign} 25")(
        lambda c, how=_how: c.lineitem.where(filters.compare("l_quantity", how, 25.0)).select("l_orderkey", "l_linenumber", "l_quantity")
    )


@query("filter_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01'")
def filter_date(c):
    return c.orders.where(filters.every(filters.compare("o_orderdate", "ge", day("1998-01-01")), filters.compare("o_orderdate", "lt", day("1998-02-01")))).select("o_orderkey")


@query("filter_colcol", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_suppkey")
def filter_colcol(c):
    return c.lineitem.where(filters.compare("l_partkey", "lt", F.col("l_suppkey"))).select("l_orderkey", "l_partkey", "l_suppkey")


@query("filter_or", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY'")
def filter_or(c):
    return c.customer.where(filters.either("c_mktsegment", "eq", "BUILDING", "MACHINERY")).select("c_custkey")


@query("filter_conj", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 AND l_discount < 0.025")
def filter_conj(c):
    return filters.select_rows(c.lineitem, filters.compare("l_returnflag", "eq", "R"), filters.compare("l_quantity", "gt", 40.0), filters.compare("l_discount", "lt", 0.025)).select("l_orderkey", "l_linenumber")


@query("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(c):
    return c.part.where(filters.between("p_size", 10, 20)).select("p_partkey", "p_size")


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red')")
def filter_contains(c):
    return c.part.where(filters.contains("p_name", "red")).select("p_partkey", "p_name")


@query("filter_starts_with", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'blue')")
def filter_starts_with(c):
    return c.part.where(filters.starts_with("p_name", "blue")).select("p_partkey", "p_name")


# projections
_ARITHMETIC = {
    "plus": ("l_partkey + l_suppkey", ("l_partkey", "l_suppkey")),
    "minus": ("1000000 - l_orderkey", (1000000, "l_orderkey")),
    "multiplies": ("l_partkey * l_suppkey", ("l_partkey", "l_suppkey")),
    "modulus": ("l_orderkey % 7", ("l_orderkey", 7)),
}
for _how, (_sql, _operands) in _ARITHMETIC.items():
    query(f"proj_arith_{_how}", f"SELECT l_orderkey, l_linenumber, {_sql} AS value FROM lineitem")(
        lambda c, how=_how, operands=_operands: c.lineitem.select("l_orderkey", "l_linenumber", projections.arithmetic(how, *operands).alias("value"))
    )


@query("proj_arith_divides", "SELECT l_orderkey, l_linenumber, l_orderkey // l_suppkey AS value FROM lineitem WHERE l_suppkey > 0")
def proj_divides(c):
    return c.lineitem.where("l_suppkey > 0").select("l_orderkey", "l_linenumber", projections.integer_divides("l_orderkey", "l_suppkey").alias("value"))


@query("proj_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS o_year FROM orders")
def proj_year(c):
    return projections.project(c.orders, o_orderkey=F.col("o_orderkey"), o_year=projections.year("o_orderdate"))


# aggregates
@query("agg_global_sum", "SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total FROM lineitem")
def agg_global_sum(c):
    return aggregates.global_aggregate(c.lineitem, total=exact_sum(cents("l_extendedprice")) / 100)


@query("agg_global_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10")
def agg_global_count(c):
    return aggregates.global_aggregate(c.lineitem.where("l_quantity < 10"), n=aggregates.count_all())


@query("agg_group_multi", "SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def agg_group_multi(c):
    return aggregates.grouped(c.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], {"qty": exact_sum(F.col("l_quantity").cast("long")), "n": aggregates.count_all()})


@query("agg_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 35")
def agg_having(c):
    return aggregates.having(c.lineitem, ["l_partkey"], {"n": aggregates.count_all()}, F.col("n") > 35)


@query("agg_avg", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_qty FROM lineitem GROUP BY 1")
def agg_avg(c):
    return aggregates.grouped(c.lineitem, ["l_returnflag"], {"avg_qty": exact_sum(F.col("l_quantity").cast("long")) / aggregates.count_all()})


@query("agg_product", "SELECT n_regionkey, CAST(product(n_nationkey + 1) AS DOUBLE) AS value FROM nation GROUP BY 1")
def agg_product(c):
    return aggregates.grouped(c.nation.withColumn("k", F.col("n_nationkey") + 1), ["n_regionkey"], {"value": aggregates.product("k")})


# joins: one query for each strategy, with the same rows
_SIDES = "SELECT l_linenumber, count(*) AS matches, sum(o_custkey) AS custkeys FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


def _sides(c):
    return c.lineitem.select(F.col("l_orderkey").alias("key"), "l_linenumber"), c.orders.select(F.col("o_orderkey").alias("key"), "o_custkey")


for _strategy in joins.STRATEGIES:
    _name = {"learned_hash": "join_learned_1level", "learned_two_level": "join_learned_2level"}.get(_strategy, f"join_{_strategy}")

    @query(_name, _SIDES)
    def join_by(c, strategy=_strategy):
        joined = joins.equi_join(*_sides(c), ["key"], "inner", strategy)
        return joined.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("matches"), F.sum("o_custkey").alias("custkeys"))


@query("join_two_key", "SELECT count(*) AS matches FROM lineitem a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_two_key(c):
    pairs = c.lineitem.where("l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    return joins.match_count(c.lineitem, pairs, ["l_partkey", "l_suppkey"])


@query("join_many_many", "SELECT count(*) AS matches FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_many_many(c):
    return joins.match_count(c.customer.select(F.col("c_nationkey").alias("key")), c.supplier.select(F.col("s_nationkey").alias("key")), ["key"], "inner", "merge")


@query("join_semi", "SELECT count(*) AS matches FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def join_semi(c):
    lines, orders = _sides(c)
    return joins.match_count(orders, lines, ["key"], "left_semi")


@query("join_semi_salted", "SELECT count(*) AS matches FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def join_semi_salted(c):
    return joins.match_count(c.customer.select(F.col("c_nationkey").alias("key")), c.supplier.select(F.col("s_nationkey").alias("key")), ["key"], "left_semi", "salted")


@query("join_bushy", "SELECT n_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size < 10 GROUP BY 1")
def join_bushy(c):
    suppliers = c.supplier.join(c.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = c.lineitem.select("l_partkey", "l_suppkey").join(c.part.where("p_size < 10").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("join_skewed_events", "SELECT event_type, count(*) AS n, sum(o_orderkey) AS orderkeys FROM events JOIN orders ON user_id = o_custkey GROUP BY 1")
def join_skewed_events(c):
    events = c.events.select(F.col("user_id").alias("key"), "event_type")
    joined = joins.equi_join(events, c.orders.select(F.col("o_custkey").alias("key"), "o_orderkey"), ["key"], "inner", "salted")
    return joined.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("orderkeys"))


# index probes
for _kind in index.KINDS:
    _title = {"sorted": "index_sorted_probe", "learned": "index_rmi_probe", "gapped": "index_gapped_probe"}[_kind]
    query(_title, "SELECT count(*) AS matches FROM orders JOIN lineitem ON o_orderkey = l_orderkey")(lambda c, kind=_kind: index.probe_total(_sides(c)[1], _sides(c)[0], "key", kind))
    query(f"{_title}_semi", "SELECT count(*) AS matches FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")(
        lambda c, kind=_kind: index.probe_total(c.supplier.select(F.col("s_nationkey").alias("key")), c.customer.select(F.col("c_nationkey").alias("key")), "key", kind, how="left_semi")
    )


@query("index_partitioned_probe", "SELECT count(*) AS matches FROM orders JOIN lineitem ON o_custkey = l_partkey")
def index_partitioned(c):
    """The way that an index takes when it is too large to broadcast."""
    return index.probe_total(c.orders.select(F.col("o_custkey").alias("key")), c.lineitem.select(F.col("l_partkey").alias("key")), "key", "learned", index_bytes=1024)


# sorts
@query("sort_learned", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position FROM lineitem")
def sort_learned(c):
    lines = c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return sorting.positions(lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").drop("l_extendedprice")


@query("sort_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_top(c):
    return sorting.top(c.orders.select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


# hashes
@query("hash_rank", "SELECT DISTINCT p_size AS key, dense_rank() OVER (ORDER BY p_size) - 1 AS slot FROM part")
def hash_rank(c):
    return hashing.monotone_rank(c.part, "p_size")


@query("hash_occupancy", "SELECT load, count(*) AS buckets, sum(load) AS keys FROM (SELECT o_custkey % 97 AS b, count(*) AS load FROM orders GROUP BY 1) GROUP BY 1")
def hash_occupancy(c):
    return hashing.occupancy(c.orders, F.col("o_custkey") % 97)


@query("dictionary_encoding", "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_id FROM customer")
def dictionary_encoding(c):
    from larkmill.sources import files

    return files.encoded(c.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment")


# generators: facts that hold for any seed
@query("gen_unique", "SELECT 10000 AS n, 10000 AS kinds, 1 AS least, 10000 AS greatest")
def gen_unique(c):
    return generators.unique_dense(c.spark, 10000).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("kinds"), F.min("key").alias("least"), F.max("key").alias("greatest"))


@query("gen_uniform_unique", "SELECT 20000 AS n, 20000 AS kinds")
def gen_uniform_unique(c):
    return generators.unique_uniform(c.spark, 20000, 3).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("kinds"))


@query("gen_foreign", "SELECT 1 + range AS key, 10 AS n FROM range(100)")
def gen_foreign(c):
    return generators.foreign_keys(c.spark, 1000, 100).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _facts(df, **facts):
    return df.agg(*(f.alias(n) for n, f in facts.items()))


@query("gen_holes", "SELECT 10000 AS n, 10000 AS kinds, true AS inside, true AS holes_everywhere")
def gen_holes(c):
    keys = generators.sequential_with_holes(c.spark, 10000, 5)
    by_block = F.countDistinct(F.expr("(key - 1) div 11")) == 1000
    return _facts(keys, n=F.count(F.lit(1)), kinds=F.countDistinct("key"), inside=(F.min("key") >= 1) & (F.max("key") <= 11000), holes_everywhere=by_block)


@query("gen_zipf", "SELECT 10000 AS n, true AS inside, true AS skewed")
def gen_zipf(c):
    counts = generators.zipf(c.spark, 10000, 5000, 1.1, 7).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return _facts(counts, n=F.sum("n"), inside=(F.min("key") >= 1) & (F.max("key") <= 5000), skewed=F.max("n").between(1000, 3000))


@query("gen_gapped", "SELECT 10000 AS n, 10000 AS kinds, true AS gaps")
def gen_gapped(c):
    """One key in ten is skipped."""
    return _facts(generators.gapped(c.spark, 10000), n=F.count(F.lit(1)), kinds=F.countDistinct("key"), gaps=(F.max("key") - F.min("key")).between(10700, 11300))


def _spread(df, low, middle, high):
    """Whether the quartiles are where the distribution has them, within a twentieth of their distance."""
    quartiles = F.percentile("key", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    near = F.lit(True)
    for k, want in enumerate((low, middle, high)):
        near &= F.abs(quartiles[k] - want) <= (high - low) / 20
    return _facts(df, n=F.count(F.lit(1)), as_expected=near)


_SPREAD = "SELECT 20000 AS n, true AS as_expected"
query("gen_lognormal", _SPREAD)(lambda c: _spread(generators.lognormal_keys(c.spark, 20000, 0.0, 0.5, 1e6), 1e6 * 0.71372, 1e6, 1e6 * 1.40111))
query("gen_normal", _SPREAD)(lambda c: _spread(generators.normal_keys(c.spark, 20000, 5000.0, 1000.0), 4325.51, 5000, 5674.49))
query("gen_uniform", _SPREAD)(lambda c: _spread(generators.uniform_keys(c.spark, 20000, 100, 100100), 25100, 50100, 75100))
query("gen_exponential", _SPREAD)(lambda c: _spread(generators.exponential_keys(c.spark, 20000, 2.0, 1e6), 143841, 346574, 693147))
query("gen_wide_uniform", _SPREAD)(lambda c: _spread(generators.wide_uniform(c.spark, 20000), 2.0**38, 2.0**39, 3 * 2.0**38))
query("gen_wide_normal", _SPREAD)(lambda c: _spread(generators.wide_normal(c.spark, 20000), 2.0**40 * (0.5 - 0.67449 / 6), 2.0**39, 2.0**40 * (0.5 + 0.67449 / 6)))


@query("gen_from_keys", "SELECT p_partkey AS key, p_partkey AS payload FROM part")
def gen_from_keys(c):
    return generators.from_keys(c.part, "p_partkey")


@query("gen_stepped", "SELECT range * 10 + 20000 AS key, range * 10 + 20000 AS payload FROM range(5000)")
def gen_stepped(c):
    return generators.stepped(c.spark, 5000)


@query("gen_window", "SELECT o_orderkey - 100 AS key, o_custkey AS payload FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
def gen_window(c):
    return generators.window_of(c.orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("payload")), 100, 5000)


@query("gen_foreign_of", "SELECT 20000 AS n, 0 AS strangers")
def gen_foreign_of(c):
    """Every drawn key is one of the given ones."""
    drawn = generators.foreign_keys_of(generators.from_keys(c.part, "p_partkey"), 20000, 3)
    known = c.part.select(F.col("p_partkey").alias("key"), F.lit(1).alias("known"))
    return _facts(drawn.join(known, "key", "left"), n=F.count(F.lit(1)), strangers=F.count(F.when(F.col("known").isNull(), 1)))


@query("gen_non_unique", "SELECT 20000 AS n, 50 AS kinds, 1 AS least, 50 AS greatest")
def gen_non_unique(c):
    return _facts(generators.non_unique(c.spark, 20000, 50, 9), n=F.count(F.lit(1)), kinds=F.countDistinct("key"), least=F.min("key"), greatest=F.max("key"))


@query("gen_downsampled", "SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS slot FROM (SELECT DISTINCT o_custkey AS key FROM orders)) WHERE slot % 7 = 0")
def gen_downsampled(c):
    return generators.downsampled(c.orders.select(F.col("o_custkey").alias("key")), 7)


# hashes of keys
@query("hash_multiplicative", "SELECT o_orderkey, CAST((((o_orderkey & 2147483647) * 1103515245) & 2147483647) >> 15 AS INT) AS bucket FROM orders")
def hash_multiplicative(c):
    return c.orders.select("o_orderkey", hashing.multiplicative("o_orderkey").alias("bucket"))


@query("hash_schemes", "SELECT s.scheme, (SELECT count(DISTINCT o_orderkey) FROM orders) AS keys, 64 AS used, true AS even FROM (VALUES ('crc32'), ('murmur'), ('xxhash')) s(scheme)")
def hash_schemes(c):
    """Every scheme uses all buckets, none with over twice its share."""
    return hashing.scheme_report(c.orders, "o_orderkey").select("scheme", "keys", "used", (F.col("fullest") * 64 <= F.col("keys") * 2).alias("even"))


@query("hash_combined", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS kinds")
def hash_combined(c):
    """Two columns' combined hash tells their pairs apart, order included."""
    return c.lineitem.select(hashing.combine(F.col("l_partkey"), F.col("l_suppkey")).alias("h")).agg(F.countDistinct("h").alias("kinds"))


# files: what is written and read back
@query("file_delimited", "SELECT r_regionkey, r_name FROM region")
def file_delimited(c):
    from larkmill.session import scratch
    from larkmill.sources import files

    folder = scratch(c.spark, "delimited")
    files.write_delimited(c.region.select("r_regionkey", "r_name", F.lit("x").alias("r_comment")), f"{folder}/region.tbl")
    tables = files.import_tables(c.spark, folder, {"region": files.TPCH["region"]}, cache=f"{folder}/cache", register=False)
    return tables["region"].select(F.col("r_regionkey").cast(c.region.schema["r_regionkey"].dataType), "r_name")


@query("file_star_date", "SELECT DISTINCT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS d_datekey, CAST(year(o_orderdate) AS INT) AS d_year FROM orders")
def file_star_date(c):
    from larkmill.session import scratch
    from larkmill.sources import files

    folder = scratch(c.spark, "star")
    names = [x.split()[0] for x in files.SSB["date"].split(", ")]
    known = c.date.select("d_datekey", "d_year", "d_yearmonthnum", "d_yearmonth", "d_weeknuminyear")
    files.write_delimited(known.select(*(F.col(n) if n in known.columns else F.lit(None).cast("string").alias(n) for n in names)), f"{folder}/date.tbl")
    return files.import_tables(c.spark, folder, {"date": files.SSB["date"]}, register=False)["date"].select("d_datekey", "d_year")


@query("file_relation", "SELECT o_orderkey AS key, o_custkey AS payload FROM orders")
def file_relation(c):
    from larkmill.session import scratch
    from larkmill.sources import files

    folder = scratch(c.spark, "relation")
    files.write_relation(c.orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("payload")), folder, 3)
    return files.read_relation(c.spark, folder)


_BINARY = "SELECT {} CAST(range * range * 1000003 AS DOUBLE) AS key, CAST(range * range * 1000003 - 5 AS DOUBLE) AS payload FROM range(2000), range(2) r(twice)"


def _binary(c, distinct):
    from larkmill.session import scratch
    from larkmill.sources import files

    path = scratch(c.spark, "keys")
    files.write_bytes(c.spark, path, files.binary_keys([k * k * 1000003 for k in range(2000) for _ in range(2)]))
    return files.read_binary_keys(c.spark, path, distinct=distinct, split_bytes=4096).select(F.col("key").cast("double"), F.col("payload").cast("double"))


query("file_binary_keys", _BINARY.format(""))(lambda c: _binary(c, False))
query("file_binary_keys_distinct", _BINARY.format("DISTINCT"))(lambda c: _binary(c, True))


@query("file_metrics", "SELECT * FROM (VALUES ('a', '1.5'), ('b', '2')) t(name, seconds)")
def file_metrics(c):
    import tempfile
    from pathlib import Path

    from larkmill.sources import files

    path = str(Path(tempfile.mkdtemp(prefix="larkmill-")) / "metrics.csv")  # the driver's own figures
    files.write_metrics(path, {"name": ["a", "b"], "seconds": ["1.5", "2"]})
    held = files.read_metrics(path)
    return c.spark.createDataFrame(list(zip(*held.values())), list(held))


@query("join_radix_2pass", _SIDES)
def join_radix_2pass(c):
    joined = joins.equi_join(*_sides(c), ["key"], "inner", "radix", bits=3, passes=2)
    return joined.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("matches"), F.sum("o_custkey").alias("custkeys"))

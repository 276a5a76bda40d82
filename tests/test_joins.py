"""All strategies agree, on duplicates, nulls, empty sides and one hot key; plans contain what they should."""

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkmill.operators import index, joins


def relation(spark, keys, name):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"key long, {name} long")


def expected(left, right, how):
    if how == "left_semi":
        return sum(k is not None and k in right for k in left)
    return sum(right.count(k) for k in left if k is not None)


CASES = [
    ([], [1, 2]),
    ([7] * 400 + list(range(50)) + [None, 4294967295, -5, 2**62, 90, 90], [7, 7, 7, 1, 2, 60, None, 4294967295, 0, -5, 2**62, 90, 90]),
    ([5, 5, 5], [5, 5]),
]


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_strategies_agree(spark, strategy, how):
    for left, right in CASES:
        got = joins.equi_join(relation(spark, left, "a"), relation(spark, right, "b"), ["key"], how, strategy)
        assert got.count() == expected(left, right, how), (strategy, how, left[:5])


@pytest.mark.parametrize("kind", index.KINDS)
@pytest.mark.parametrize("limit", [1 << 20, 16])
def test_index_probes_agree(spark, kind, limit):
    for build, probe in CASES:
        for how in ("inner", "left_semi"):
            got = index.probe_total(relation(spark, build, "a"), relation(spark, probe, "b"), "key", kind, how=how, index_bytes=limit)
            want = expected(probe, build, how)
            assert got.first()["matches"] == want, (kind, limit, how, build[:5])


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-(2**40), 2**40), max_size=60), st.lists(st.integers(-(2**40), 2**40), max_size=30))
def test_index_finds_all_and_only(keys, probes):
    import numpy as np

    distinct = np.unique(np.array(keys, np.int64))
    look = np.array(probes + keys[:10], np.int64)
    for build in (index.SortedIndex, index.LearnedIndex, index.GappedIndex):
        found = build(distinct, np.ones(len(distinct), np.int64)).find(look)
        assert [f >= 0 for f in found] == [k in set(keys) for k in look.tolist()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    left, right = (spark.range(1000).selectExpr("id AS key", f"id AS {name}") for name in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(joins.equi_join(left, right, ["key"], "inner", "broadcast"))
        assert "ShuffledHashJoin" in plan(joins.equi_join(left, right, ["key"], "inner", "shuffle_hash"))
        assert "SortMergeJoin" in plan(joins.equi_join(left, right, ["key"], "inner", "merge"))
        learned = plan(joins.equi_join(left, right, ["key"], "inner", "learned_partitioned"))
        assert "SortMergeJoin" in learned and "hashpartitioning" not in learned  # the learned shuffle is enough
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_measures_rows_not_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1 << 18)
    spark.range(40000).selectExpr("id AS key", "'the same' AS b").coalesce(1).write.parquet(f"{tmp_path}/packed")
    left, right = spark.range(100).selectExpr("id AS key", "id AS a"), spark.read.parquet(f"{tmp_path}/packed")
    assert joins.estimated_bytes(right) <= 1 << 18 < 40000 * 32 == joins.measured_bytes(right)
    joined = joins.equi_join(left, right, ["key"], "inner", "broadcast")
    assert "SortMergeJoin" in plan(joined) and joined.count() == 100
    assert "BroadcastHashJoin" in plan(joins.equi_join(left, right.limit(100), ["key"], "inner", "broadcast"))


def test_filters_reach_the_scan(spark):
    from larkmill import plans

    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        text = plan(plans.QUERIES["tpch_q6"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThan(l_quantity,24.0)" in text and "GreaterThanOrEqual(l_discount,0.045)" in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text


def exchanges(df):
    import re

    return re.findall(r"Exchange (\w+)\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_range_and_two_pass_radix_joins_shuffle_each_side_once(spark):
    left, right = spark.range(5000).selectExpr("id % 700 as key", "id as a"), spark.range(900).selectExpr("id as key", "id as b")
    for strategy, by, options in (("range", "range_part", {"parts": 6}), ("radix", "radix_part", {"bits": 3, "passes": 2})):
        joined = joins.equi_join(left, right, ["key"], "inner", strategy, **options)
        found = exchanges(joined)
        assert len(found) == 2 and all(by in keys for _, keys in found), found
        assert joined.count() == 5000


def test_ranges_ascend_and_a_heavy_key_is_dealt(spark):
    left = spark.range(20_000).selectExpr("if(id % 3 = 0, 42, id) as key", "id as a")
    right = spark.range(20_000).selectExpr("id as key", "id * 2 as b")
    bounds, heavy = joins.equi_depth(left, right, "key", 40)
    assert bounds == sorted(set(bounds)) and heavy == [42.0]
    at = {r["key"]: r["at"] for r in right.select("key", joins.range_of("key", bounds).alias("at")).collect()}
    assert all(v == sum(b <= k for b in bounds) for k, v in list(at.items())[::97])
    joined = joins.range_join(left, right, ["key"], parts=40)
    assert joined.count() == 20_000
    spread = [r["n"] for r in joined.where("key = 42").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(spread) > 8

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkmill.functions import models
from larkmill.operators import sorting

KEYS = st.lists(st.integers(-(2**45), 2**45), max_size=200)


@settings(max_examples=100, deadline=None)
@given(KEYS, KEYS, st.integers(1, 50), st.integers(1, 40))
def test_buckets_are_in_range_and_monotone(sample, keys, leaves, buckets):
    got = models.train(sample, leaves).bucket(np.sort(np.array(keys, np.float64)), buckets)
    assert ((got >= 0) & (got < buckets)).all() and (np.diff(got) >= 0).all()


@settings(max_examples=60, deadline=None)
@given(KEYS, KEYS, st.integers(1, 40))
def test_splines_are_monotone_and_close(sample, keys, buckets):
    model = models.train_spline(sample, 0.01)
    got = model.bucket(np.sort(np.array(keys, np.float64)), buckets)
    assert ((got >= 0) & (got < buckets)).all() and (np.diff(got) >= 0).all()
    distinct, first = np.unique(np.array(sample, np.float64), return_index=True)
    if len(distinct) > 1:
        whole = models.train_spline(sample, 1e-12)
        assert np.abs(model.cdf(distinct) - whole.cdf(distinct)).max() <= 0.01 + 1e-9


def test_spline_column(spark):
    keys = np.unique(np.exp(np.random.default_rng(1).normal(8, 2, 3000)).astype(np.int64))
    model = models.train_spline(keys)
    got = spark.createDataFrame([(int(k),) for k in keys], "key long").select("key", model.leaf_column("key", 16).alias("b")).orderBy("key").toPandas()["b"]
    assert got.is_monotonic_increasing and np.abs(got.to_numpy() - model.bucket(keys, 16)).max() <= 1
    assert np.bincount(got, minlength=16).max() < 2 * len(keys) / 16


def test_columns_agree_with_arrays(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(np.exp(rng.normal(8, 2, 3000)).astype(np.int64))
    model = models.train(keys, 64)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long").select("key", model.leaf_column("key", 16).alias("two"), model.column("key", 16).alias("one")).orderBy("key").toPandas()
    assert (df["two"].to_numpy() == model.bucket(keys, 16)).all()
    assert df["one"].is_monotonic_increasing
    fullest = {c: np.bincount(df[c], minlength=16).max() for c in ("one", "two")}
    assert fullest["two"] < 0.6 * fullest["one"]  # leaves follow a skewed distribution better than one line


def test_learned_sort_is_global(spark):
    df = spark.range(5000).select((F.abs(F.xxhash64("id")) % 700).alias("key"), "id").union(spark.createDataFrame([(None, -1)], "key long, id long"))
    rows = [(r["key"], r["id"]) for r in sorting.learned_sort(df, "key", "id", buckets=7).collect()]
    assert rows == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    placed = sorting.positions(df, "key", "id", buckets=7).orderBy("position").collect()
    assert [(r["key"], r["id"]) for r in placed] == rows and [r["position"] for r in placed] == list(range(5001))


def test_degenerate_samples(spark):
    for sample in ([], [3], [3, 3, 3]):
        assert models.train(sample).bucket(np.array([1.0, 3.0, 9.0]), 4).tolist() == [0, 0, 0]


def test_samples_are_bounded_and_even(spark):
    df = spark.range(50_000).selectExpr("if(id % 2 = 0, 7, id) as key")
    sample = models.sample_keys(df, "key", 5000)
    assert len(sample) == 5000 and 0.45 < (sample == 7).mean() < 0.55 and abs(np.median(sample[sample != 7]) - 25_000) < 2500
    assert len(models.sample_keys(df.limit(0), "key")) == 0
    both = models.sample_pair(df, spark.range(50_000, 100_000).withColumnRenamed("id", "key"), "key", 5000)
    assert 0.45 < (both >= 50_000).mean() < 0.55

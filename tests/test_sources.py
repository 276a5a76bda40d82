from pyspark.sql import functions as F

from larkmill.functions import hashing
from larkmill.sources import files, generators as g


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_generators_keep_their_promises(spark):
    n = 2000
    assert rows(g.unique_dense(spark, 5)) == [(k, k) for k in range(1, 6)]
    assert {r["payload"] for r in g.unique_dense(spark, 5, payload=0).collect()} == {0}
    holes = g.sequential_with_holes(spark, n, 3)
    assert holes.select("key").distinct().count() == holes.count() and abs(holes.count() - n) < n / 10
    wide = g.unique_uniform(spark, n, 9)
    assert wide.agg(F.countDistinct("key"), F.min("key") > 0, F.max("key") <= 2**32).first()[:] == (n, True, True)
    assert g.foreign_keys(spark, n, 7).groupBy("key").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert g.foreign_keys_of(g.stepped(spark, 50), n).join(g.stepped(spark, 50), "key", "left_anti").count() == 0
    assert abs(g.normal_keys(spark, n, 1e6, 1000.0).agg(F.avg("key")).first()[0] - 1e6) < 200
    assert g.exponential_keys(spark, n, 2.0, 1e6).agg(F.abs(F.avg("key") - 5e5) < 5e4).first()[0]
    assert g.uniform_keys(spark, n, 10, 20).agg(F.min("key"), F.max("key")).first()[:] == (10, 19)
    assert g.lognormal_keys(spark, n, 0, 1, 100).agg(F.min("key") >= 0).first()[0]
    assert rows(g.stepped(spark, 3)) == [(20000, 20000), (20010, 20010), (20020, 20020)]
    gapped = [r["key"] for r in g.gapped(spark, n).orderBy("payload").collect()]
    assert all(b - a in (1, 2) for a, b in zip(gapped, gapped[1:])) and 1.03 < gapped[-1] / n < 1.17
    assert g.wide_normal(spark, n).agg((F.min("key") >= 0) & (F.max("key") <= 2**40)).first()[0]
    assert g.wide_uniform(spark, n).count() == g.non_unique(spark, n, 5).count() == n
    counts = [r["count"] for r in g.zipf(spark, 20000, 5000, 1.2, 4).groupBy("key").count().orderBy(F.desc("count")).collect()]
    assert sum(counts) == 20000 and counts[0] > 1.8 * counts[1] > 0
    assert g.window_of(g.stepped(spark, 10), 20010, 20030).agg(F.min("key"), F.count("key")).first()[:] == (0, 2)
    assert g.downsampled(g.unique_dense(spark, 100), 10).count() == 10
    assert g.from_keys(spark.range(3), "id").count() == 3


def test_same_seed_same_rows(spark):
    for make in (lambda s: g.unique_uniform(spark, 500, s), lambda s: g.zipf(spark, 500, 50, 1.0, s), lambda s: g.lognormal_keys(spark, 500, 0, 2, 100, s)):
        assert rows(make(5)) == rows(make(5)) != rows(make(6))


def test_relations_round_trip(spark, tmp_path):
    relation = g.unique_dense(spark, 100)
    files.write_relation(relation, str(tmp_path / "r"), 3)
    assert rows(files.read_relation(spark, str(tmp_path / "r"))) == rows(relation)
    (tmp_path / "t.txt").write_text("#KEY, VAL\n3 4\n5\n\n7, 8\n")
    assert rows(files.read_relation(spark, str(tmp_path / "t.txt"))) == [(3, 4), (5, 5), (7, 8)]
    keys = files.materialize_keys(relation, "key", str(tmp_path / "k"))
    assert [r["key"] for r in keys.collect()] == list(range(1, 101))


def test_binary_keys(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(files.binary_keys([2**63 + 9, 5, 5]))
    got = files.read_binary_keys(spark, str(tmp_path / "a.bin"))
    assert sorted(int(r["key"]) for r in got.collect()) == [5, 5, 2**63 + 9] and {int(r["key"] - r["payload"]) for r in got.collect()} == {5}
    assert [int(r["key"]) for r in files.read_binary_keys(spark, str(tmp_path / "a.bin"), distinct=True).collect()] == [5, 2**63 + 9]
    (tmp_path / "b.bin").write_bytes(files.binary_keys([7, 8], 4))
    assert sorted(int(r["key"]) for r in files.read_binary_keys(spark, str(tmp_path / "b.bin"), width=4).collect()) == [7, 8]


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0|c|\n 1|ARGENTINA|1||\n")
    got = files.import_tables(spark, str(tmp_path), {"nation": files.TPCH["nation"]}, cache=str(tmp_path / "cache"))["nation"]
    assert [tuple(r)[:3] for r in got.orderBy("n_nationkey").collect()] == [(0, "ALGERIA", 0), (1, "ARGENTINA", 1)]
    assert spark.table("nation").count() == 2
    files.write_delimited(got, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert all(len(files.read_delimited(spark, str(tmp_path / "nation.tbl"), s).columns) == len(s.split(", ")) for s in files.SSB.values())


def test_dictionary_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string")
    assert rows(files.encoded(df, "s").na.fill({"s": "", "s_id": -1})) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]
    files.write_metrics(str(tmp_path / "m.csv"), {"a": [1, 2], "b": [3, 4]})
    assert files.read_metrics(str(tmp_path / "m.csv")) == {"a": ["1", "2"], "b": ["3", "4"]}


def test_hashes(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    for name, scheme in hashing.SCHEMES.items():
        placed = df.select(hashing.bucket(scheme("key"), 10).alias("b")).groupBy("b").count()
        assert placed.count() == 10, name
    assert df.select(hashing.multiplicative("key", 8).alias("b")).agg(F.min("b") >= 0, F.max("b") < 256, F.countDistinct("b") > 150).first()[:] == (True, True, True)
    assert [r["slot"] for r in hashing.monotone_rank(df, "key", 5).orderBy("key").collect()] == list(range(1000))
    assert df.select(hashing.combine(hashing.xx("key"), hashing.murmur("key")).alias("h")).distinct().count() == 1000
    assert hashing.occupancy(df, F.col("key") % 10).first()[:] == (100, 10, 1000)

from pyspark.sql import functions as F

from larkmill.operators.aggregates import count_all
from larkmill.streaming import incremental


def test_windows_and_joins(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:10", 1, "a"), ("2024-01-01 00:00:50", 2, "a"), ("2024-01-01 00:09:00", 1, "b"), ("2024-01-01 01:00:00", 9, "a")], "ts string, user long, kind string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    users = spark.createDataFrame([(1,), (2,)], "user long")
    stream = incremental.read_stream(spark, str(tmp_path / "in"), "ts timestamp, user long, kind string")
    counts = incremental.windowed(stream, "ts", ["kind"], {"n": count_all()}, width="5 minutes", late="1 minute")
    incremental.run_once(counts, str(tmp_path / "out"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "out")).select("kind", "n").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 1)]  # the last window is still open
    incremental.run_once(incremental.enriched(incremental.read_stream(spark, str(tmp_path / "in"), "ts timestamp, user long, kind string"), users, ["user"]), str(tmp_path / "joined"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "joined")).count() == 3

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, median seconds of three runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from larkmill import plans
from larkmill.session import local_session

HEADLINE = (
    ["tpch_q1", "tpch_q3", "tpch_q5", "tpch_q6", "tpch_q9", "tpch_q18", "ssb_q11", "ssb_q21", "ssb_q31", "ssb_q41"]
    + [f"join_{s}" for s in ("auto", "broadcast", "shuffle_hash", "merge", "radix", "salted", "learned_1level", "learned_2level", "learned_partitioned")]
    + ["index_sorted_probe", "index_rmi_probe", "sort_learned"]
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "16g", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    rows = {name: spark.read.parquet(f"{folder}/{name}.parquet").count() for name in ("orders", "lineitem")}
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:  # the first compiles
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 4)
    both = rows["orders"] + rows["lineitem"]
    throughput = {n: round(both / t / 1e6, 3) for n, t in seconds.items() if n.startswith(("join_", "index_"))}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rpartition("sf")[2], "runs": RUNS, "join_million_rows_per_sec": throughput}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads. Each query is fully
evaluated into a sink that keeps nothing; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES
from ledgerlens.session import tuned

HEADLINE = (
    "client_features_rt",
    "client_features_batch",
    "client_features_usd",
    "trans_enhanced",
    "client_snapshot",
    "chrono_split",
    "split_tables",
    "decision_line",
    "rank_similarity",
    "top_targets",
    "lookalike_targets",
    "knn_label",
    "stream_totals",
    "state_upsert",
    "stream_score",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        tuned(SparkSession.builder.master(f"local[{cpus}]"))
        .appName("ledgerlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Times the headline queries warm (median of three runs, results written nowhere) and prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from joinlab.queries import QUERIES

NAMES = ("join_inner", "join_build_left", "join_leftdeep3", "join_chain", "join_star", "join_bushy4", "join_equiv_class", "join_wide", "select_min_agg", "select_min_oneshot", "plan_import", "filter_nested", "filter_like_multi")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

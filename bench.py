"""Wall-clock of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["neighbor_mean", "zonal_stats", "combination", "cross_matrix", "classify_md", "pivot_two", "join_left", "raster_report", "resample_avg", "calc_ndvi"]


def main() -> None:
    from gridloom.queries import QUERIES
    from gridloom.session import make_spark

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = make_spark("bench", cpus, int(cpus), spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        each = []
        for _ in range(4):  # the first warms up
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - t)
        took[name] = round(median(each[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

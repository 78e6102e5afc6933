"""Times the catalogue's queries: prints one JSON line. BENCH_SF_DIR: folder of tables. BENCH_CPUS: threads. BENCH_RUNS: timed runs of each after one warm-up; the median counts."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


def main() -> None:
    from pyspark.sql import SparkSession

    from snapledger.plans.queries import QUERIES

    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in QUERIES.items():
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "catalogue queries, seconds in all", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()

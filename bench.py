"""Seconds per query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from checks.queries import QUERIES
from pairwright.workspace import release


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    seconds, jobs = {}, {}
    # Start the JVM's and the Python workers' side of the session before the clock runs.
    spark.range(1000, numPartitions=int(cpus)).mapInArrow(lambda batches: batches, "id long").count()
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "jobs": jobs,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()

"""Run queries next to their SQL and report differences: ``python -m checks.compare [sf] [name…]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES
from pairwright.workspace import release

TABLES = ["orders", "documents", "embeddings", "benchmark", "conversations"]


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def oracle_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection.execute(sql).fetchdf()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(r) for r in frame.itertuples(index=False)), key=repr)


def main() -> int:
    sf, *names = sys.argv[1:] or ["0.01"]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        ours = QUERIES[name](spark, sf_dir).toPandas()
        middle = time.time()
        theirs = oracle_rows(sf_dir, ORACLE[name]) if name in ORACLE else None
        end = time.time()
        if theirs is None:
            verdict = "no oracle"
        else:
            mine, other = canonical(ours), canonical(theirs)
            verdict = "ok" if mine == other and set(ours.columns) == set(theirs.columns) else "DIFFERENT"
            if verdict != "ok":
                bad += 1
                print(list(ours.columns), list(theirs.columns))
                for a, b in [(a, b) for a, b in zip(mine, other) if a != b][:2]:
                    print("  spark ", repr(a)[:400])
                    print("  duckdb", repr(b)[:400])
        print(f"{name:24s} {len(ours):8d} rows {verdict:10s} spark {middle - start:6.2f}s duckdb {end - middle:6.2f}s", flush=True)
    release(spark)
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Token tables: Parquet, one folder per split, positions kept as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "row_id long, ord long, org_text string, encoded_text array<int>, "
    "decoded_text array<string>, split string"
)


#: Splits a task writes side by side; with more of them, rows are sorted by split first.
OPEN_SPLITS = 8
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_tokens(tokens: DataFrame, path: str) -> None:
    """A folder for each split. Rows are written as they come: sorting them by split would spill every
    row with its arrays, many times as wide as in the files."""
    conf = tokens.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, str(OPEN_SPLITS))
    try:
        tokens.write.partitionBy("split").parquet(path)
    finally:
        conf.set(_WRITERS, before)


def read_tokens(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All splits, or only the folder of one."""
    tokens = spark.read.schema(SCHEMA).parquet(path)
    return tokens if split is None else tokens.where(F.col("split") == split)

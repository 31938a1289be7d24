"""How an input table is laid out over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of little data over all cores; a large one as its files are cut.

    A small file is often a single row group, which only one task can read. The size is the
    optimizer's own estimate, so a table that is large enough to fill the cluster is never moved.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)

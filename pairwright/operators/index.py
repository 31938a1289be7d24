"""A contiguous row number over a total order, without one task holding all rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairwright.workspace import materialize

_IN_PARTITION = (1 << 33) - 1
MAX_RUNS = 100_000


def contiguous_index(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    name: str = "ord",
    row_key: Sequence[str] = (),
) -> DataFrame:
    """Add ``name``: 0, 1, 2, … by ``order_by``, restarting for every value of ``within``.

    Rows are range-partitioned and sorted by ``within`` and ``order_by`` and written once with
    their place in their partition, so that the counting and the numbering see the same layout.
    Counts are one row per partition and group. For as many as fit the driver they are summed up
    there and broadcast; for a ``within`` of very many values that too is a distributed join.
    ``order_by`` has to tell rows of a group apart and ``within`` has to be free of nulls.

    With a unique, non-null ``row_key`` only the key columns are sampled, sorted and written, and
    the numbers are joined to the rows afterwards: the way for rows much wider than their keys.
    """
    if row_key:
        narrow = df.select(*dict.fromkeys([*row_key, *within, *order_by]))
        numbers = contiguous_index(narrow, order_by, within, name)
        return df.join(numbers.select(*row_key, name), list(row_key)).select(*df.columns, name)
    keys = [*within, *order_by]
    staged = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_place": F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION),
            }
        ),
        name,
    )
    runs = staged.groupBy("_part", *within).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows")
    )
    held = runs.limit(MAX_RUNS + 1).collect()
    if len(held) <= MAX_RUNS:
        shifts = F.broadcast(_shifts_here(runs, held, within))
    else:
        shifts = _shifts_apart(runs, within)
    return (
        staged.join(shifts, ["_part", *within])
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .select(*df.columns, name)
    )


def _shifts_here(runs: DataFrame, held: list[Row], within: Sequence[str]) -> DataFrame:
    done: dict[tuple, int] = {}
    rows = []
    for run in sorted(held, key=lambda r: r["_part"]):
        group = tuple(run[c] for c in within)
        before = done.get(group, 0)
        done[group] = before + run["_rows"]
        rows.append((run["_part"], *group, before - run["_first"]))
    kept = runs.select("_part", *within, F.col("_first").alias("_shift")).schema
    columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), kept.fields)] if rows else [
        pa.array([], to_arrow_type(f.dataType)) for f in kept.fields
    ]
    return runs.sparkSession.createDataFrame(pa.Table.from_arrays(columns, kept.names), kept)


def _shifts_apart(runs: DataFrame, within: Sequence[str]) -> DataFrame:
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    return runs.select("_part", *within, (before - F.col("_first")).alias("_shift"))

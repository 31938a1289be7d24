"""A look at a table: its shape, its first rows, one row by position."""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def shape(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of rows and columns, by split if asked."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def first_rows(df: DataFrame, order_by: Sequence[str] = ("ord",), n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def record_at(df: DataFrame, position: int, ord_column: str = "ord") -> DataFrame:
    """The row at one position of a numbered table."""
    return df.where(F.col(ord_column) == position)


def _row_counts(values: Sequence[str], by: str) -> list:
    return [F.count(F.when(F.col(by) == value, 1)).alias(value) for value in values]


def observe_rows(df: DataFrame, values: Sequence[str], by: str = "split") -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows by the given values of a column while it is written, with no scan of its own.

    ``Observation.get`` waits for the first action on the frame and has a count for each value.
    """
    counted = Observation()
    return df.observe(counted, *_row_counts(values, by)), counted


def batch_numbers(rows: Mapping[str, int], sizes: Mapping[str, int]) -> dict[str, int]:
    """Batches of each split: ceil(rows / size)."""
    return {split: -(-n // sizes[split]) for split, n in rows.items()}


def observe_stream(df: DataFrame, values: Sequence[str], by: str = "split", name: str = "rows") -> DataFrame:
    """The same for a stream; ``RowCounts`` of that name adds up what its batches report."""
    return df.observe(name, *_row_counts(values, by))


class RowCounts(StreamingQueryListener):
    """Counts of ``observe_stream`` over the batches of this run, added up as they end."""

    def __init__(self, name: str = "rows"):
        self.name = name
        self.counts: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            with self._lock:
                for value, n in found.asDict().items():
                    self.counts[value] = self.counts.get(value, 0) + n

    def onQueryTerminated(self, event) -> None:
        pass

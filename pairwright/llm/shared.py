"""Intermediate tables in the shared folder, for iterations that must not keep their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairwright.workspace import materialize


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the folder in ``spark.checkpoint.dir`` and read back."""
    return materialize(df, f"llm-{label}")

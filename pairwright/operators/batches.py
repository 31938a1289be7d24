"""Fixed-size batches of token rows, padded to the longest row of the batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.config import END_OF_TEXT, Settings
from pairwright.functions.arrays import (
    drop_first,
    drop_last,
    keep_first,
    mask_after_first,
    terminate_and_pad,
)


def batch_of(size: int, ord_column: str = "ord") -> Column:
    """Batch number of a row from its contiguous position."""
    return F.expr(f"`{ord_column}` div {int(size)}")


def load_batches(tokens: DataFrame, split: str, settings: Settings = Settings()) -> DataFrame:
    """Rows of one split with their batch number; the last batch may be short."""
    size = settings.batch_size(split)
    rows = tokens.where(F.col("split") == split) if "split" in tokens.columns else tokens
    return rows.withColumn("batch_id", batch_of(size))


def collate(
    batches: DataFrame,
    settings: Settings = Settings(),
    texts: bool = False,
    by: Sequence[str] = ("batch_id",),
) -> DataFrame:
    """Add ``inputs`` and ``targets``, and with ``texts`` the same shift of the token texts.

    Every row ends in one pad and is filled up to the longest row of its batch; targets are one
    step ahead and count their first pad only; both are cut to the maximum length afterwards.
    One exchange, on the batch, of groups as large as a batch.
    """
    width = F.max(F.size("encoded_text") + 1).over(Window.partitionBy(*by))
    return _collated(batches.withColumn("_width", width), batches.columns, settings, texts)


def collate_stored(rows: DataFrame, settings: Settings = Settings(), texts: bool = False) -> DataFrame:
    """``collate`` for rows of a table laid out by batches, which hold the ``width`` of their batch.

    A projection: no exchange, however the scan cuts the files.
    """
    return _collated(rows.withColumn("_width", F.col("width")), rows.columns, settings, texts)


def _collated(wide: DataFrame, columns: Sequence[str], settings: Settings, texts: bool) -> DataFrame:
    padded = wide.withColumn(
        "_padded", terminate_and_pad(F.col("encoded_text"), F.lit(settings.pad_id), F.col("_width"))
    )
    targets = mask_after_first(drop_first(F.col("_padded")), settings.pad_id, settings.ignore_index)
    made = [
        keep_first(drop_last(F.col("_padded")), settings.max_length).alias("inputs"),
        keep_first(targets, settings.max_length).alias("targets"),
    ]
    if texts:
        filled = terminate_and_pad(F.col("decoded_text"), F.lit(END_OF_TEXT), F.col("_width"))
        padded = padded.withColumn("_filled", filled)
        made += [F.col("_filled").alias("inputs_txt"), drop_first(F.col("_filled")).alias("targets_txt")]
    return padded.select(*columns, *made)


def collate_with(batches: DataFrame, function, schema: str, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Batches through a function of one's own: one pandas frame per batch in, one out."""
    return batches.groupBy(*by).applyInPandas(function, schema)


def batch_stats(batches: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Rows, tokens and padded width of every batch."""
    length = F.size("encoded_text")
    return batches.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.sum(length).alias("n_tokens"),
        F.max(length + 1).alias("padded_length"),
    )


def batch_count(rows: DataFrame, size: int) -> DataFrame:
    """One row, ``n_batches``: ceil(rows / size)."""
    return rows.agg(F.ceil(F.count("*") / F.lit(size)).alias("n_batches"))


def export_batches(
    collated: DataFrame, columns: Sequence[str] = ("inputs", "targets"), by: Sequence[str] = ("batch_id",)
) -> DataFrame:
    """One row per batch, each column a matrix in row order."""
    held = F.sort_array(F.collect_list(F.struct("ord", *columns)))
    return (
        collated.groupBy(*by)
        .agg(held.alias("_rows"))
        .select(*by, *(F.col(f"_rows.{c}").alias(c) for c in columns))
    )

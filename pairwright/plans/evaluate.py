"""Batches of a token table, and the loss of a model or of a logits table over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.config import Settings
from pairwright.operators.batches import collate, collate_stored, load_batches
from pairwright.operators.loss import (
    Model,
    batch_losses,
    explode_positions,
    mean_of_batches,
    model_batch_losses,
)


def model_inputs(
    tokens: DataFrame, split: str, settings: Settings = Settings(), texts: bool = False
) -> DataFrame:
    """Collated rows of one split: what a model is to score; a table laid out by batches needs no exchange."""
    if {"width", "batch_id", "split"} <= set(tokens.columns):
        settings.batch_size(split)
        return collate_stored(tokens.where(F.col("split") == split), settings, texts)
    return collate(load_batches(tokens, split, settings), settings, texts)


def model_loss(
    tokens: DataFrame, split: str, model: Callable[[], Model], settings: Settings = Settings()
) -> DataFrame:
    """Mean of batch means of a model over one split, one row (``loss``)."""
    rows = model_inputs(tokens, split, settings)
    return mean_of_batches(model_batch_losses(rows, model, ignore=settings.ignore_index))


def stored_loss(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The same from stored rows (batch_id, targets, logits), logits one matrix per row."""
    positions = explode_positions(scored.select("batch_id", "logits", "targets"))
    return mean_of_batches(batch_losses(positions, ignore=settings.ignore_index))

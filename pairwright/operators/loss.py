"""Masked cross-entropy over logits tables, as a mean of batch means."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.config import IGNORE_INDEX, Settings
from pairwright.functions.arrays import argmax, cross_entropy

# A model takes the input ids of some rows and returns one (positions x vocabulary) matrix each.
Model = Callable[[list[np.ndarray]], list[np.ndarray]]


def explode_positions(batches: DataFrame, logits: str = "logits", targets: str = "targets") -> DataFrame:
    """One row per position from one row per sequence: ``pos``, ``logits``, ``target``."""
    others = [c for c in batches.columns if c not in (logits, targets)]
    zipped = F.arrays_zip(F.col(logits).alias("logits"), F.col(targets).alias("target"))
    rows = batches.select(*others, F.posexplode(zipped).alias("pos", "_p"))
    return rows.select(*others, "pos", F.col("_p.logits").alias("logits"), F.col("_p.target").alias("target"))


def position_loss(logits: Column, target: Column, ignore: int = IGNORE_INDEX) -> Column:
    """Loss of one position; null where the target is to be ignored, an error where it is no place."""
    inside = (target >= 0) & (target < F.size(logits))
    wrong = F.raise_error(F.concat(F.lit("no logit for target "), target.cast("string"))).cast("double")
    loss = F.when(inside, cross_entropy(logits.cast("array<double>"), target)).otherwise(wrong)
    return F.when(target != ignore, loss)


def _mean(column: str) -> Column:
    return F.coalesce(F.avg(column), F.lit(float("nan")))


def batch_losses(
    positions: DataFrame,
    by: Sequence[str] = ("batch_id",),
    logits: str = "logits",
    target: str = "target",
    ignore: int = IGNORE_INDEX,
) -> DataFrame:
    """Mean loss of every batch. Logits are reduced to one number before anything is shuffled."""
    scored = positions.select(*by, position_loss(F.col(logits), F.col(target), ignore).alias("nll"))
    return scored.groupBy(*by).agg(_mean("nll").alias("batch_loss"))


def _counted(target: np.ndarray, ignore: int) -> slice | np.ndarray:
    """Places that count: a range if they follow one another, which takes no copy of the logits."""
    at = np.flatnonzero(target != ignore)
    return slice(int(at[0]), int(at[-1]) + 1) if len(at) and at[-1] - at[0] + 1 == len(at) else at


def _mass(rows: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Sum of exponentials below ``top`` of each row."""
    below = rows - top[:, None]
    return np.exp(below, out=below).sum(axis=1)


def _row_loss(logits: np.ndarray, target: np.ndarray, ignore: int) -> tuple[float, int]:
    counted = _counted(target, ignore)
    wanted = target[counted]
    if ((wanted < 0) | (wanted >= logits.shape[-1])).any():
        raise ValueError(f"targets are from 0 to {logits.shape[-1] - 1}")
    rows = logits[counted].astype(np.float64, copy=False)
    top = rows.max(axis=1, initial=-np.inf)
    norm = top + np.log(_mass(rows, top))
    return float((norm - rows[np.arange(len(rows)), wanted]).sum()), len(rows)


def model_batch_losses(
    collated: DataFrame,
    model: Callable[[], Model],
    by: Sequence[str] = ("batch_id",),
    ignore: int = IGNORE_INDEX,
    rows_per_call: int = Settings().rows_per_call,
) -> DataFrame:
    """Mean loss of every batch under a model of one's choice, built once per task.

    The model sees ``rows_per_call`` rows at a time, and their logits are reduced before the next.

    Each row leaves its task as a loss sum and a position count; logits are never stored.
    """
    keys = list(by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model()
        for frame in frames:
            sums, counts = [], []
            inputs, targets = list(frame["inputs"]), list(frame["targets"])
            for begin in range(0, len(inputs), rows_per_call):
                part = slice(begin, begin + rows_per_call)
                for logits, target in zip(score(inputs[part]), targets[part]):
                    total, count = _row_loss(np.asarray(logits), np.asarray(target), ignore)
                    sums.append(total)
                    counts.append(count)
            yield frame[keys].assign(loss_sum=sums, positions=counts)

    fields = ", ".join(f"`{k}` {collated.schema[k].dataType.simpleString()}" for k in keys)
    sums = collated.select(*keys, "inputs", "targets").mapInPandas(
        run, f"{fields}, loss_sum double, positions long"
    )
    return _batch_means(sums, keys)


def shard_terms(
    shards: DataFrame, by: Sequence[str], logits: str = "logits", start: str = "start", target: str = "target"
) -> DataFrame:
    """One slice of a position's logits as four numbers: ``top``, the largest; ``mass``, the sum of exponentials
    below it; ``wanted``, the target's logit if it lies here; with ``start``, ``size`` and ``target``.

    Two such rows of one position merge into one: the larger top, masses scaled to it and added.
    """
    values = F.col(logits).cast("array<double>")
    top = F.array_max(values)
    mass = F.aggregate(values, F.lit(0.0), lambda total, x: total + F.when(x == top, 1.0).otherwise(F.exp(x - top)))
    place = F.col(target) - F.col(start)
    wanted = F.when((place >= 0) & (place < F.size(values)), F.get(values, place.cast("int")))
    return shards.where(F.size(logits) > 0).select(
        *by,
        F.col(start).cast("long").alias("start"),
        F.size(values).alias("size"),
        F.col(target).alias("target"),
        top.alias("top"),
        mass.alias("mass"),
        wanted.alias("wanted"),
    )


def sharded_position_losses(
    shards: DataFrame,
    by: Sequence[str],
    logits: str = "logits",
    start: str = "start",
    target: str = "target",
    ignore: int = IGNORE_INDEX,
) -> DataFrame:
    """(by, nll): the loss of every position whose logits are stored as slices of the vocabulary.

    A row is a slice: ``start``, the id of its first logit, and the position's target. However wide the
    vocabulary, no row is wider than a slice, and each slice is four numbers before anything is
    shuffled. Slices of a position have to follow one another from 0 without gap or overlap and
    agree on the target; a target beyond them is an error, an ignored one a null loss.
    """
    terms = F.struct("start", "size", "target", "top", "mass", "wanted")
    held = shard_terms(shards, by, logits, start, target).groupBy(*by).agg(F.sort_array(F.collect_list(terms)).alias("s"))
    ends = F.aggregate("s", F.lit(0).cast("long"), lambda end, x: F.when(x["start"] == end, end + x["size"]).otherwise(F.lit(-1).cast("long")))
    top = F.array_max(F.col("s.top"))
    scaled = lambda total, x: total + F.when(x["top"] == top, x["mass"]).otherwise(x["mass"] * F.exp(x["top"] - top))
    mass = F.aggregate("s", F.lit(0.0), scaled)
    wanted = F.array_max(F.col("s.wanted"))
    aim = F.array_max(F.col("s.target"))
    wrong = lambda *say: F.raise_error(F.concat(*say)).cast("double")
    loss = (
        F.when(ends < 0, wrong(F.lit("slices of a position overlap or leave a gap")))
        .when(aim != F.array_min(F.col("s.target")), wrong(F.lit("slices of a position have different targets")))
        .when(aim == ignore, F.lit(None).cast("double"))
        .when(aim.isNotNull() & wanted.isNull(), wrong(F.lit("no logit for target "), aim.cast("string")))
        .otherwise(F.log(mass) + top - wanted)
    )
    return held.select(*by, loss.alias("nll"))


def sharded_batch_losses(
    shards: DataFrame,
    position: Sequence[str],
    by: Sequence[str] = ("batch_id",),
    logits: str = "logits",
    start: str = "start",
    target: str = "target",
    ignore: int = IGNORE_INDEX,
) -> DataFrame:
    """``batch_losses`` of logits in slices: ``position`` names the columns that tell positions of a batch apart."""
    keys = list(dict.fromkeys([*by, *position]))
    scored = sharded_position_losses(shards, keys, logits, start, target, ignore)
    return scored.groupBy(*by).agg(_mean("nll").alias("batch_loss"))


def _sliced_loss(slices: Iterator[tuple[int, np.ndarray]], target: np.ndarray, ignore: int) -> tuple[float, int]:
    """(sum of losses, positions counted) of one row, whose logits come slice by slice."""
    counted = _counted(target, ignore)
    aim = target[counted]
    top, mass = np.full(len(aim), -np.inf), np.zeros(len(aim))
    wanted, end = np.full(len(aim), np.nan), 0
    for start, logits in slices:
        rows = np.asarray(logits)[counted].astype(np.float64, copy=False)
        if not rows.shape[1]:
            continue
        higher = np.maximum(top, rows.max(axis=1))
        mass = mass * np.exp(top - higher) + _mass(rows, higher)
        top, end = higher, start + rows.shape[1]
        here = np.flatnonzero((aim >= start) & (aim < end))
        wanted[here] = rows[here, aim[here] - start]
    if np.isnan(wanted).any():
        raise ValueError(f"targets are from 0 to {end - 1}")
    return float((np.log(mass) + top - wanted).sum()), len(aim)


# A model in slices takes the input ids of some rows and a range of ids, and returns one
# (positions x range) matrix each.
SlicedModel = Callable[[list[np.ndarray], int, int], list[np.ndarray]]


def sliced_model_batch_losses(
    collated: DataFrame,
    model: Callable[[], SlicedModel],
    vocabulary: int,
    slice_ids: int = 4096,
    by: Sequence[str] = ("batch_id",),
    ignore: int = IGNORE_INDEX,
) -> DataFrame:
    """``model_batch_losses`` of a model that is asked for ``slice_ids`` logits of a position at a time.

    What a task holds is one row's slice, whatever the vocabulary.
    """
    keys = list(by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model()
        for frame in frames:
            made = []
            for ids, target in zip(frame["inputs"], frame["targets"]):
                cuts = range(0, vocabulary, slice_ids)
                slices = ((a, score([ids], a, min(a + slice_ids, vocabulary))[0]) for a in cuts)
                made.append(_sliced_loss(slices, np.asarray(target), ignore))
            yield frame[keys].assign(loss_sum=[t for t, _ in made], positions=[n for _, n in made])

    fields = ", ".join(f"`{k}` {collated.schema[k].dataType.simpleString()}" for k in keys)
    sums = collated.select(*keys, "inputs", "targets").mapInPandas(run, f"{fields}, loss_sum double, positions long")
    return _batch_means(sums, keys)


def _batch_means(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    total, count = F.sum("loss_sum"), F.sum("positions")
    mean = F.when(count > 0, total / count).otherwise(F.lit(float("nan")))
    return sums.groupBy(*by).agg(mean.alias("batch_loss"))


def mean_of_batches(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of batch means; NaN without batches."""
    return losses.groupBy(*by).agg(_mean("batch_loss").alias("loss"))


def checkpoint_losses(losses: DataFrame, every: int = 500) -> DataFrame:
    """(epoch, batch_id, split, batch_loss) -> train and validation loss at every k-th batch."""
    report = F.format_string(
        "epoch %d, batch %06d: train %s, validation %s",
        F.col("epoch") + 1,
        F.col("batch_id"),
        _six_digits(F.col("train")),
        _six_digits(F.col("val")),
    )
    return (
        losses.where(F.col("batch_id") % every == 0)
        .groupBy("epoch", "batch_id")
        .pivot("split", ["train", "val"])
        .agg(F.avg("batch_loss"))
        .fillna(float("nan"), ["train", "val"])
        .select(
            "epoch",
            "batch_id",
            F.col("train").alias("train_loss"),
            F.col("val").alias("val_loss"),
            report.alias("report"),
        )
    )


def _six_digits(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit("nan")).otherwise(F.format_string("%.6f", value))


def next_choice(
    positions: DataFrame, by: Sequence[str], pos: str = "pos", logits: str = "logits"
) -> DataFrame:
    """The best next token after the last position of every sequence.

    Each logits vector becomes one number where it is read; only numbers are shuffled.
    """
    chosen = positions.select(*by, pos, argmax(F.col(logits)).alias("choice"))
    return chosen.groupBy(*by).agg(F.max_by("choice", pos).alias("choice"))

"""Bounded samples of labelled rows for fitting a model, the same in every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELS = 1000


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(rows: DataFrame, by: Sequence[str], label: str, most: int) -> DataFrame:
    """About ``most`` rows, as evenly over the labels as these have rows, and twice ``most`` at most.

    Labels are counted over all rows; each then keeps the share of its rows, chosen by a hash of
    the columns ``by``, that is expected to give its part of ``most``. Rows alike in these columns stand or
    fall together; where that leaves none or too many, the first rows are taken.
    """
    counts = {r[label]: r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"a model is fitted for {MAX_LABELS} labels at most")
    left, open_, share = most, sorted(counts, key=counts.get), {}
    for place, value in enumerate(open_):
        part = left // (len(open_) - place)
        share[value] = min(1.0, part / counts[value])
        left -= min(part, counts[value])
    keep = F.lit(0.0)
    for value, rate in share.items():
        keep = F.when(F.col(label) == F.lit(value), F.lit(rate)).otherwise(keep)
    draw = F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(1 << 30)) / float(1 << 30)
    known = rows.where(F.col(label).isNotNull())
    drawn = known.where(draw < keep)
    found = drawn.limit(2 * most + 1).count()
    if 0 < found <= 2 * most:
        return drawn
    return (drawn if found else known).limit(most)

"""Exact-size, reproducible splits without a global sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIGITS = 4
_HASH_DIGITS = 32
#: Rows with the same first digits of the hash that are ranked one by one.
SMALL = 10_000


def shuffle_key(key: str, seed: int = 42) -> Column:
    """The hash that stands for a row's place in the shuffled order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


@dataclass
class _Cut:
    """The row sought: the one of rank ``place`` among the ``rows`` whose hash begins with ``prefix``."""

    place: int
    prefix: str = ""
    rows: int = 0


def _descend(cut: _Cut, counts: list[tuple[str, int]]) -> None:
    """Follow a cut into the group of longer prefixes it falls in."""
    for prefix, rows in counts:
        if cut.place <= rows:
            cut.prefix, cut.rows = prefix, rows
            return
        cut.place -= rows
    raise ValueError("the table changed while it was split")


def _counts(ranked: DataFrame, cuts: Sequence[_Cut], digits: int) -> dict[str, list[tuple[str, int]]]:
    """Rows by ``digits`` digits of the hash, in the groups of the cuts: 65,536 counts a cut at most."""
    before = digits - _DIGITS
    inside = ranked.where(F.substring("hash", 1, before).isin(sorted({c.prefix for c in cuts}))) if before else ranked
    found: dict[str, list[tuple[str, int]]] = {}
    for r in inside.groupBy(F.substring("hash", 1, digits).alias("prefix")).count().collect():
        found.setdefault(r["prefix"][:before], []).append((r["prefix"], r["count"]))
    return {prefix: sorted(counts) for prefix, counts in found.items()}


def split_at(
    df: DataFrame, fractions: Sequence[float], key: str = "row_id", seed: int = 42, small: int = SMALL
) -> list[DataFrame]:
    """Parts of exactly ceil(f * n) rows up to each sum f of ``fractions``, and the rest, all in one run.

    Rows are ranked by the hash of their unique ``key``. Cuts are found digit by digit: a histogram of the
    next four digits inside the groups in which the cuts fall, until a group has ``small`` rows at most,
    which are ranked. Parts are plain filters on the input, without a shuffle. A null key, or a
    key that is repeated where a cut falls, is an error: no row is lost.
    """
    sums = [math.fsum(fractions[: i + 1]) for i in range(len(fractions))]
    if not sums or any(f <= 0 for f in fractions):
        raise ValueError("fractions are more than 0")
    ranked = df.select(F.col(key).alias("key"), shuffle_key(key, seed).alias("hash"))
    first = ranked.groupBy(F.substring("hash", 1, _DIGITS).alias("prefix")).count().collect()
    nulls = sum(r["count"] for r in first if r["prefix"] is None)
    if nulls:
        raise ValueError(f"{nulls} rows have no {key}")
    total = sum(r["count"] for r in first)
    cuts = [_Cut(math.ceil(total * f)) for f in sums]
    if not total or cuts[-1].place >= total:
        raise ValueError("too few rows to split")
    counts = sorted((r["prefix"], r["count"]) for r in first)
    for cut in cuts:
        _descend(cut, counts)
    digits = _DIGITS
    while digits < _HASH_DIGITS and (open_ := [c for c in cuts if c.rows > small]):
        # A cut that is done waits; the others take the next digits.
        digits += _DIGITS
        found = _counts(ranked, open_, digits)
        for cut in open_:
            _descend(cut, found[cut.prefix])
    bounds = [_bound(ranked, cut, key, small) for cut in cuts]
    own = shuffle_key(key, seed)
    upto = [(own < h) | ((own == h) & (F.col(key) <= F.lit(k))) for h, k in bounds]
    parts = [df.where(here & ~before) for here, before in zip(upto, [F.lit(False), *upto])]
    return [*parts, df.where(~upto[-1])]


def _bound(ranked: DataFrame, cut: _Cut, key: str, small: int) -> tuple:
    """(hash, key) of the row at the cut, from a group that is small."""
    group = ranked.where(F.startswith("hash", F.lit(cut.prefix)))
    if cut.rows > small:
        raise ValueError(f"{cut.rows} rows have the {key} {group.first()['key']}, where the split falls")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("hash", "key"))
    last = group.withColumn("place", place).where(F.col("place").isin(cut.place, cut.place + 1)).orderBy("place").collect()
    if len(last) == 2 and last[0]["key"] == last[1]["key"]:
        raise ValueError(f"several rows have the {key} {last[0]['key']}, where the split falls")
    return last[0]["hash"], last[0]["key"]


def exact_split(
    df: DataFrame, key: str = "row_id", fraction: float = 0.1, seed: int = 42, small: int = SMALL
) -> tuple[DataFrame, DataFrame]:
    """(train, valid): valid holds exactly ceil(fraction * n) rows, train all others."""
    valid, train = split_at(df, [fraction], key, seed, small)
    return train, valid

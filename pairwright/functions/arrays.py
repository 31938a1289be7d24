"""Array expressions: padding, shifting, masking, windows, softmax, loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def terminate_and_pad(items: Column, fill: Column, width: Column) -> Column:
    """Append one terminator, then the same value up to ``width`` elements."""
    missing = F.greatest(width - F.size(items), F.lit(1)).cast("int")
    return F.concat(items, F.array_repeat(fill, missing))


def drop_last(items: Column) -> Column:
    return F.slice(items, 1, F.size(items) - 1)


def drop_first(items: Column) -> Column:
    return F.slice(items, 2, F.size(items) - 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mask_after_first(items: Column, pad: int, ignore: int) -> Column:
    """Keep the first pad, replace every later one by ``ignore``."""
    first = F.array_position(items, F.lit(pad)).cast("int")
    rest = F.slice(items, first + 1, F.size(items) - first)
    masked = F.transform(rest, lambda v: F.when(v == pad, F.lit(ignore)).otherwise(v))
    return F.when(first == 0, items).otherwise(F.concat(F.slice(items, F.lit(1), first), masked))


def keep_first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def keep_last(items: Column, limit: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - limit + 1, F.lit(1)), limit)


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    """Probabilities of one logits vector, shifted by its maximum."""
    powers = let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))

    def normalize(shares: Column) -> Column:
        total = F.aggregate(shares, F.lit(0.0), lambda acc, v: acc + v)
        return let(total, lambda t: F.transform(shares, lambda v: v / t))

    return let(powers, normalize)


def cross_entropy(values: Column, target: Column) -> Column:
    """``logsumexp(values) - values[target]`` for one position; target counts from zero."""

    def loss(top: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return top + F.log(total) - F.get(values, target)

    return let(F.array_max(values), loss)

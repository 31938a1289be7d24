"""Ids to labels in query text, and labels back to ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.ids import (
    LABEL_BOUNDED,
    extract_bounded_eids,
    extract_labels,
    stitch,
)
from pairwright.operators.dictionary import eid_to_label, label_to_eid
from pairwright.operators.lookup import BROADCAST_BYTES, lookup, lookup_held


def _rewritten(text: Column, pairs: Column) -> Column:
    labels = F.transform(pairs, lambda p: F.coalesce(p["value"], p["key"]))
    return F.when(F.size(pairs) > 0, stitch(text, labels)).otherwise(text)


def _restored(text: Column, pairs: Column, bounded: bool) -> Column:
    if bounded:
        between = F.split(text, LABEL_BOUNDED, -1)
        eids = F.transform(pairs, lambda p: F.coalesce(p["value"], p["key"]))
        ends = F.concat(eids, F.array(F.lit("")))
        whole = F.array_join(F.flatten(F.zip_with(between, ends, lambda a, b: F.array(a, b))), "")
    else:
        known = F.array_distinct(F.filter(pairs, lambda p: p["value"].isNotNull()))
        whole = F.aggregate(known, text, lambda acc, p: F.replace(acc, p["key"], p["value"]))
    return F.when(F.size(pairs) > 0, whole).otherwise(text)


def encode_ids(
    df: DataFrame,
    dictionary: DataFrame,
    text: str = "sparql",
    out: str = "sparql_modf",
    row_key: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``out``: ``text`` with every whole-word id of the dictionary replaced by its label.

    Ids outside the dictionary stay, null stays null. Rows without ids are not moved; ``row_key``
    names columns that tell the others apart, so that they need not be written first.
    """
    keyed = df.withColumn("_ids", extract_bounded_eids(F.col(text)))
    found = lookup(keyed, "_ids", eid_to_label(dictionary), "_pairs", row_key, broadcast_bytes)
    return found.select(*df.columns, _rewritten(F.col(text), F.col("_pairs")).alias(out))


def encode_ids_inline(
    df: DataFrame, dictionary: DataFrame, text: str = "sparql", out: str = "sparql_modf"
) -> DataFrame:
    """``encode_ids`` for a dictionary that is small, which is checked: works on a stream."""
    keyed = df.withColumn("_ids", extract_bounded_eids(F.col(text)))
    found = lookup_held(keyed, "_ids", eid_to_label(dictionary), "_pairs")
    return found.select(*df.columns, _rewritten(F.col(text), F.col("_pairs")).alias(out))


def decode_labels(
    df: DataFrame,
    dictionary: DataFrame,
    text: str = "sparql_modf",
    out: str = "decoded_sparql",
    bounded: bool = False,
    row_key: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``out``: ``text`` with labels replaced by their ids.

    Labels are found as whole words, then replaced one after the other wherever they occur,
    also inside longer ones. ``bounded=True`` replaces the whole words only.
    """
    keyed = df.withColumn("_labels", extract_labels(F.col(text)))
    found = lookup(keyed, "_labels", label_to_eid(dictionary), "_pairs", row_key, broadcast_bytes)
    return found.select(*df.columns, _restored(F.col(text), F.col("_pairs"), bounded).alias(out))


def decode_labels_inline(
    df: DataFrame, dictionary: DataFrame, text: str = "sparql_modf", out: str = "decoded_sparql"
) -> DataFrame:
    """``decode_labels`` for a dictionary that is small, which is checked: works on a stream."""
    keyed = df.withColumn("_labels", extract_labels(F.col(text)))
    found = lookup_held(keyed, "_labels", label_to_eid(dictionary), "_pairs")
    return found.select(*df.columns, _restored(F.col(text), F.col("_pairs"), False).alias(out))

"""Replace every element of an array column by what a key-value table holds for it.

Ids to labels and labels to ids are this one join: many keys per row, one table, values back in
the order of the keys. Rows without keys are left where they are. Of the others the keys alone are
joined to the table, which is broadcast up to a measured size; beyond, keys are spread by a salt
taken from their row, and the table meets the distinct (salt, key) pairs only, so that a key which
holds a third of all places reaches the table at most once per salt. Values then come back to
their rows by the row's key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.workspace import materialize

#: Bytes of keys and values of a table that is broadcast.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class KeyTable:
    """A table with unique ``key``s."""

    frame: DataFrame
    key: str
    value: str

    def entries(self) -> DataFrame:
        """(key, value) without null keys; a repeated key is an error."""
        held = self.frame.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("key"))
        held = held.agg(F.count("*").alias("n"), F.first(self.value).alias("value"))
        kind = held.schema["value"].dataType.simpleString()
        repeated = F.raise_error(F.concat(F.lit("the table repeats the key "), F.col("key").cast("string"))).cast(kind)
        return held.select("key", F.when(F.col("n") > 1, repeated).otherwise(F.col("value")).alias("value"))

    def bytes(self) -> int:
        """What keys and values take, counted, with some room for each row."""
        size = F.octet_length(F.col(self.key).cast("string")) + F.coalesce(F.octet_length(F.col(self.value).cast("string")), F.lit(0))
        return self.frame.agg(F.coalesce(F.sum(size + 32), F.lit(0))).first()[0]


def _in_order(placed: DataFrame, slots: int, taken: Callable[[Column], Column]) -> DataFrame:
    """(slot, held) rows -> one row with the array of ``taken(held)`` by slot, null in the gaps."""
    spark = placed.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "held")))
    return every.join(placed, "slot", "left").agg(
        F.transform(ordered, lambda s: taken(s["held"])).alias("slots")
    )


def _null_pairs(keys: str, value_type: str) -> Column:
    null = F.lit(None).cast(value_type)
    return F.transform(keys, lambda k: F.struct(k.alias("key"), null.alias("value")))


def lookup(
    df: DataFrame,
    keys: str,
    table: KeyTable,
    out: str = "pairs",
    row_key: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """Swap array column ``keys`` for ``out``: array<struct<key, value>>, value null if absent.

    ``row_key`` names columns that tell rows with keys apart and are not null, which is checked
    for these rows; without them all rows are numbered and written once. With a ``row_key``, ``df`` is read three times. There are as many salts as shuffle
    partitions unless ``salts`` says how many.
    """
    entries = table.entries()
    value_type = entries.schema["value"].dataType.simpleString()
    others = [c for c in df.columns if c != keys]
    if not row_key:
        # All rows are written, so that what made them runs once, not again for the rows without keys.
        df = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
        row_key = ["_row"]
    asks = F.coalesce(F.exists(keys, lambda k: k.isNotNull()), F.lit(False))
    plain = df.where(~asks).select(*others, _null_pairs(keys, value_type).alias(out))
    open_ = df.where(asks)
    place = F.posexplode(keys).alias("place", "key")
    asked = open_.select(*row_key, place)
    if table.bytes() <= broadcast_bytes:
        known = asked.join(F.broadcast(entries), "key", "left")
    else:
        salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = asked.withColumn("salt", F.pmod(F.xxhash64(*row_key), F.lit(salts)))
        wanted = salted.where(F.col("key").isNotNull()).select("salt", "key").distinct()
        known = salted.join(wanted.join(entries, "key"), ["salt", "key"], "left")
    held = F.sort_array(F.collect_list(F.struct("place", "key", "value")))
    # The left join keeps null keys of rows in sight; they have no answers.
    answers = known.groupBy(*row_key).agg(held.alias("_held"))
    pairs = F.transform("_held", lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    wrong = F.raise_error(F.lit(f"{', '.join(row_key)}: null, or the same in several rows")).cast(
        f"array<struct<key:{entries.schema['key'].dataType.simpleString()},value:{value_type}>>"
    )
    checked = F.when(F.size(F.coalesce("_held", F.array())) == F.size(keys), pairs).otherwise(wrong)
    met = open_.join(answers, list(row_key), "left").select(*others, checked.alias(out))
    return plain.unionByName(met)


def lookup_held(df: DataFrame, keys: str, table: KeyTable, out: str = "pairs", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The same, row by row and without a shuffle, for streams: every task holds the table, whose size is checked."""
    if table.bytes() > most_bytes:
        raise ValueError("the table is too large to be held by every task")
    entries = table.entries()
    held = entries.toArrow()
    sent = df.sparkSession.sparkContext.broadcast([held.column(c).combine_chunks() for c in ("key", "value")])
    kinds = [entries.schema[c].dataType.simpleString() for c in ("key", "value")]

    def find(lists: pa.Array) -> pa.Array:
        known, values = sent.value
        asked = lists.flatten()
        found = values.take(pc.index_in(asked.cast(known.type), value_set=known))
        sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        edges = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        pairs = pa.StructArray.from_arrays([asked, found], ["key", "value"])
        return pa.ListArray.from_arrays(edges, pairs, mask=lists.is_null())

    run = F.arrow_udf(find, f"array<struct<key:{kinds[0]},value:{kinds[1]}>>")
    others = [c for c in df.columns if c != keys]
    return df.select(*others, run(F.col(keys)).alias(out))


def values_by_number(
    df: DataFrame, keys: str, entries: DataFrame, size: int, out: str, message: str
) -> DataFrame:
    """Swap array column ``keys`` for ``out``, the values of keys from 0 to ``size`` - 1.

    The number itself is the slot. A key without a value is an error that says ``message``.
    """
    placed = entries.select(F.col("key").cast("int").alias("slot"), F.col("value").alias("held"))
    others = [c for c in df.columns if c != keys]
    held = df.withColumn("_slots", _in_order(placed, size, lambda value: value).scalar())
    value_type = entries.schema["value"].dataType.simpleString()

    def value(key: Column) -> Column:
        missing = F.raise_error(F.concat(F.lit(message), key.cast("string"))).cast(value_type)
        return F.coalesce(F.get(F.col("_slots"), key), missing)

    return held.select(*others, F.transform(keys, value).alias(out))

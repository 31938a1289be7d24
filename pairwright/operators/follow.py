"""Greedy generation by a next-token table of any size, as joins.

What such a table generates depends on the last token of a prompt alone. So the walk from every
token is made once, by doubling: a walk of n steps is continued by the walk of n steps from where
it ends, and the number of joins grows with the logarithm of the length. Prompts then meet the walks of their
last tokens in one join. Frequent ends and last tokens are spread by salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.config import Settings
from pairwright.workspace import materialize

SALTS = 16
#: Bytes of walks that are broadcast at most.
BROADCAST_BYTES = 16 << 20


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _salt(*of: Column | str) -> Column:
    return F.pmod(F.xxhash64(*of) + F.spark_partition_id(), F.lit(SALTS))


def walks(successors: DataFrame, steps: int, stop_id: int) -> DataFrame:
    """(prev, walk): the ids that follow every token, ``steps`` at most, up to the stop or to a token without
    a successor. ``successors`` is (prev, next), one row for each token; a repeated token is an error."""
    twice = F.raise_error(F.concat(F.lit("the table repeats the token "), F.col("prev").cast("string"))).cast("int")
    once = successors.groupBy("prev").agg(F.count("*").alias("n"), F.first("next").cast("int").alias("next"))
    next_ = F.when(F.col("n") > 1, twice).otherwise(F.col("next"))
    begun = once.select(F.col("prev").cast("int").alias("prev"), next_.alias("next"))
    going = begun.where((F.col("next") >= 0) & (F.col("next") != stop_id))
    held = materialize(going.select("prev", F.array("next").alias("walk")), "walks")
    length = 1
    while length < steps:
        # A walk that is shorter than all could be has ended.
        open_ = held.where(F.size("walk") == length)
        far = _salted(held.select(F.col("prev").alias("end"), F.col("walk").alias("more")))
        on = open_.withColumn("end", F.element_at("walk", -1)).withColumn("salt", _salt("prev"))
        grown = on.join(far, ["end", "salt"], "left")
        longer = grown.select("prev", F.concat("walk", F.coalesce("more", F.array().cast("array<int>"))).alias("walk"))
        held = materialize(held.where(F.size("walk") < length).unionByName(longer), "walks")
        length *= 2
        if held.where(F.size("walk") == length).isEmpty():
            break
    return held.select("prev", F.slice("walk", 1, steps).alias("walk"))


def follow_table(
    prompts: DataFrame,
    successors: DataFrame,
    ids: str = "encoded_text",
    out: str = "generated",
    settings: Settings = Settings(),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``out``: the same as ``greedy_decode`` with a ``table_scorer`` of ``successors``, whatever its size.

    Walks are broadcast up to ``broadcast_bytes``, counted; beyond, prompts are shuffled once, by
    last token and salt. A null id list stays null, an empty one empty.
    """
    found = walks(successors, settings.max_new_tokens, settings.pad_id)
    held = found.agg(F.coalesce(F.sum(F.size("walk") * 4 + 16), F.lit(0))).first()[0]
    last = F.try_element_at(F.col(ids), F.lit(-1)).cast("int")
    on = prompts.withColumn("_last", last)
    walked = found.select(F.col("prev").alias("_last"), F.col("walk").alias("_walk"))
    if held <= broadcast_bytes:
        met = on.join(F.broadcast(walked), "_last", "left")
    else:
        met = on.withColumn("_salt", _salt(ids)).join(_salted(walked).withColumnRenamed("salt", "_salt"), ["_last", "_salt"], "left")
    made, whole = F.size("_walk"), F.concat(F.col(ids).cast("array<int>"), F.col("_walk"))
    kept = F.least(F.size(ids) + made - 1, F.lit(settings.context_length)) + 1
    grown = F.when(F.col("_walk").isNull(), F.col(ids).cast("array<int>")).otherwise(F.slice(whole, -kept, kept))
    return met.select(*prompts.columns, grown.alias(out))

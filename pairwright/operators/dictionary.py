"""The id dictionary: distinct ids, numbered and labelled, usable in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.config import LABEL_PREFIX, UNKNOWN_EID
from pairwright.functions.ids import extract_eids, numbered_label
from pairwright.operators.index import contiguous_index
from pairwright.operators.lookup import KeyTable


def all_queries(*frames: DataFrame, column: str = "sparql_wikidata") -> DataFrame:
    """Union all of one query column."""
    first, *rest = (f.select(column) for f in frames)
    for frame in rest:
        first = first.unionByName(frame)
    return first


def count_eids(queries: DataFrame, column: str = "sparql_wikidata") -> DataFrame:
    """Distinct ids of the non-null queries and how often each is used."""
    found = F.explode_outer(extract_eids(F.col(column))).alias("eid")
    return (
        queries.where(F.col(column).isNotNull())
        .select(found)
        .where(F.col("eid").isNotNull())
        .groupBy("eid")
        .agg(F.count("*").alias("uses"))
    )


def build_dictionary(queries: DataFrame, column: str = "sparql_wikidata") -> DataFrame:
    """(eid, label, uses) for every id of the corpus, plus the row for unknown ids.

    Ids are numbered from 1 in byte order. All labels are as wide as the number of ids.
    """
    numbered = contiguous_index(count_eids(queries, column), ["eid"], name="number")
    width = len(str(numbered.count()))
    known = numbered.select(
        "eid", numbered_label(F.col("number") + 1, width).alias("label"), "uses"
    )
    unknown = queries.sparkSession.range(0, 1, 1, 1).select(
        F.lit(UNKNOWN_EID).alias("eid"),
        F.lit(LABEL_PREFIX + "0" * width).alias("label"),
        F.lit(0).cast("long").alias("uses"),
    )
    return known.unionByName(unknown)


def eid_to_label(dictionary: DataFrame) -> KeyTable:
    return KeyTable(dictionary, "eid", "label")


def label_to_eid(dictionary: DataFrame) -> KeyTable:
    return KeyTable(dictionary, "label", "eid")

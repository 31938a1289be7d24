"""The id dictionary as JSON, one row per line or one flat object per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "eid string, label string, uses long"


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """One table for both directions, as JSON lines, with the frequencies where there are any."""
    kept = [c for c in ("eid", "label", "uses") if c in dictionary.columns]
    dictionary.select(*kept).write.json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(eid, label, uses); ``uses`` is null where the files have none."""
    return spark.read.schema(_ROW).json(path)


def read_flat_object(spark: SparkSession, path: str, key: str = "eid") -> DataFrame:
    """(eid, label) from files that hold one flat JSON object, laid out one entry per line.

    Lines are parsed on their own, so a file is split over tasks. ``key`` says which of the
    two columns the object's keys are.
    """
    value = "label" if key == "eid" else "eid"
    body = F.regexp_replace(F.regexp_replace("value", r"^\s*\{", ""), r"[\s,}]+$", "")
    entry = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,string>")
    return (
        spark.read.text(path)
        .where(F.length(body) > 0)
        .select(F.explode(entry).alias(key, value))
        .select("eid", "label")
    )

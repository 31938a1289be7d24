"""A stored dictionary that grows by versions and never changes a label it has given.

A version is a folder of the ids that came with one batch of queries. Ids that no earlier version
has are numbered in byte order behind the largest number so far. All labels are ``width`` digits
wide for good, so that no label begins another; a number that needs more digits is an error. A version
counts once its writing is committed: what a failed run leaves is overwritten, and a version that
is there already is left as it is, so that a batch may be repeated. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pairwright.config import LABEL_PREFIX, UNKNOWN_EID
from pairwright.functions.ids import numbered_label
from pairwright.operators.dictionary import count_eids
from pairwright.operators.index import contiguous_index
from pairwright.workspace import committed

SCHEMA = "eid string, label string, number long"


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, in order."""
    return sorted(int(name.removeprefix("version=")) for name in committed(spark, path) if name.startswith("version="))


def read_grown(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(eid, label, number, version) of all versions, or of those up to one."""
    held = [v for v in versions_of(spark, path) if version is None or v <= version]
    if not held:
        return spark.createDataFrame([], f"{SCHEMA}, version long")
    read = spark.read.schema(f"{SCHEMA}, version long").option("basePath", path)
    return read.parquet(*(f"{path}/version={v}" for v in held))


def grow_dictionary(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    version: int,
    column: str = "sparql_wikidata",
    width: int = 12,
) -> DataFrame:
    """Add the new ids of ``queries`` as ``version`` and return the dictionary up to it.

    Versions come in rising order; the first also holds the row for unknown ids, number 0. ``width`` has to be the
    same for all. Queries without ids make an empty version.
    """
    held = versions_of(spark, path)
    if version in held:
        return read_grown(spark, path, version)
    if held and version < held[-1]:
        raise ValueError(f"version {held[-1]} is already there, so {version} cannot be added")
    known = read_grown(spark, path)
    last = known.agg(F.max("number"), F.max(F.length("label"))).first()
    if held and last[1] != len(LABEL_PREFIX) + width:
        raise ValueError(f"the labels at {path} are {last[1] - len(LABEL_PREFIX)} digits wide, not {width}")
    found = count_eids(queries, column).select("eid")
    fresh = found.join(known.select("eid"), "eid", "left_anti") if held else found
    number = F.col("place") + ((last[0] or 0) + 1)
    numbered = contiguous_index(fresh, ["eid"], name="place").select("eid", number.alias("number"))
    wide = F.raise_error(F.concat(F.lit(f"labels of {width} digits have no room for "), F.col("number").cast("string")))
    label = F.when(F.col("number") < F.lit(10**width), numbered_label(F.col("number"), width)).otherwise(wide.cast("string"))
    rows = numbered.select("eid", label.alias("label"), "number")
    if not held:
        unknown = [(UNKNOWN_EID, LABEL_PREFIX + "0" * width, 0)]
        rows = rows.unionByName(spark.createDataFrame(unknown, SCHEMA))
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    return read_grown(spark, path, version)


def grow_from_stream(
    queries: DataFrame, path: str, checkpoint: str, column: str = "sparql_wikidata", width: int = 12, **trigger
) -> StreamingQuery:
    """Start a stream that adds each batch as the version of its batch id; a repeated batch changes nothing.

    ``trigger`` goes to the writer, such as ``availableNow=True``.
    """

    def grow(batch: DataFrame, batch_id: int) -> None:
        grow_dictionary(batch.sparkSession, path, batch, batch_id, column, width)

    writer = queries.select(column).writeStream.foreachBatch(grow).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

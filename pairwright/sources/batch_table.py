"""Token tables laid out by batches: whole batches in each file, in order, with their padded width.

The width is the only thing a row has to know of the others of its batch. It is stored with the
row, so that collating a stored table is a projection. Files hold whole batches, sorted by
position, in a folder for each split and part; a batch or a record is found by its folder, and in
the file by the statistics of its pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.config import Settings
from pairwright.workspace import committed

_LAYOUT = "layout string, split string, batch_size int, batches_per_file int"
#: Small pages and groups of rows, so that one record reads little.
_PAGES = {"parquet.block.size": str(32 << 20), "parquet.page.row.count.limit": "1000"}


def laid_out(tokens: DataFrame, settings: Settings, batches_per_file: int) -> DataFrame:
    """Rows with ``batch_id``, ``part`` and ``width``, one exchange away: parts together and in order."""
    size = F.raise_error(F.concat(F.lit("no batch size for split "), F.col("split"))).cast("int")
    for split in settings.batch_sizes:
        size = F.when(F.col("split") == split, F.lit(settings.batch_size(split))).otherwise(size)
    placed = tokens.withColumn("batch_id", F.floor(F.col("ord") / size))
    placed = placed.withColumn("part", F.floor(F.col("batch_id") / batches_per_file)).repartition("split", "part")
    whole = Window.partitionBy("split", "part", "batch_id").orderBy("ord").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    wide = placed.withColumn("width", F.max(F.size("encoded_text") + 1).over(whole))
    return wide.sortWithinPartitions("split", "part", "ord")


def write_token_batches(
    tokens: DataFrame, path: str, settings: Settings = Settings(), batches_per_file: int = 10_000
) -> None:
    """Write (split, ord, encoded_text, …) with ``batch_id`` and ``width`` added, a file for every
    ``batches_per_file`` batches. Positions are contiguous in each split; a split without a batch size
    is an error. An empty table gives a table without rows.
    """
    spark = tokens.sparkSession
    laid = laid_out(tokens, settings, batches_per_file)
    laid.write.options(**_PAGES).partitionBy("split", "part").parquet(f"{path}/rows")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema.fields)
    rows = [(kept, split, size, batches_per_file) for split, size in settings.batch_sizes.items()]
    spark.createDataFrame(rows, _LAYOUT).coalesce(1).write.parquet(f"{path}/layout")


def read_token_batches(
    spark: SparkSession, path: str, split: str | None = None, first: int | None = None, last: int | None = None
) -> DataFrame:
    """All rows, those of a split, or those of its batches ``first`` to ``last``; only the files that hold them
    are opened, and of these the pages."""
    layout = {r["split"]: r for r in spark.read.schema(_LAYOUT).parquet(f"{path}/layout").collect()}
    held = next(iter(layout.values()))
    rows = spark.read.schema(held["layout"]).parquet(f"{path}/rows")
    if split is None:
        return rows.drop("part")
    if split not in layout:
        raise NotImplementedError(f"no batch size for split {split!r}")
    rows = rows.where(F.col("split") == split)
    size, each = layout[split]["batch_size"], layout[split]["batches_per_file"]
    if first is not None:
        rows = rows.where((F.col("part") >= first // each) & (F.col("ord") >= first * size))
    if last is not None:
        rows = rows.where((F.col("part") <= last // each) & (F.col("ord") < (last + 1) * size))
    return rows.drop("part")


def read_record(spark: SparkSession, path: str, split: str, ord: int) -> DataFrame:
    """The row at a position of a split, or none."""
    size = next(r["batch_size"] for r in spark.read.schema(_LAYOUT).parquet(f"{path}/layout").collect() if r["split"] == split)
    return read_token_batches(spark, path, split, ord // size, ord // size).where(F.col("ord") == ord)


def is_batch_table(spark: SparkSession, path: str) -> bool:
    """Whether both halves of a table were committed."""
    return committed(spark, path) == ["layout", "rows"]

"""Pair tables: CSV in and out, literal rows, and the working column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.config import QUERY_SOURCE, QUESTION_SOURCE
from pairwright.operators.index import MAX_RUNS
from pairwright.sources.csv_blocks import read_csv_blocks
from pairwright.workspace import materialize

# What a pandas CSV reader takes for a missing field.
PANDAS_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
_QUOTING = {"header": True, "quote": '"', "escape": '"'}
_WRITING = _QUOTING | {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str | None = None,
    pandas_missing: bool = False,
    multiline: bool = True,
) -> DataFrame:
    """A CSV file or folder with a header; quoted commas, quotes and newlines are kept.

    Without a schema every column is text under its header name. Files are split into blocks that
    many tasks read; ``multiline=False`` saves a scan where no field holds a line break.
    ``pandas_missing`` turns the usual words for a missing value into null.
    """
    if multiline:
        frame = read_csv_blocks(spark, path, schema)
    else:
        reader = spark.read.options(**_QUOTING)
        frame = (reader.schema(schema) if schema else reader).csv(path)
    return _missing(frame) if pandas_missing else frame


def _missing(frame: DataFrame) -> DataFrame:
    return frame.select(
        *(
            F.when(F.col(f.name).isin(PANDAS_MISSING), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
            if f.dataType.simpleString() == "string"
            else F.col(f.name)
            for f in frame.schema.fields
        )
    )


def write_csv(df: DataFrame, path: str, max_rows_per_file: int = 1_000_000) -> None:
    """A folder of CSV files with a header each; field edges are left alone."""
    df.write.options(**_WRITING, maxRecordsPerFile=max_rows_per_file).csv(path)


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``row_id`` to rows straight from a file scan: by file name, then by place in the file.

    A scan yields the rows of a block of a file in order and in one task, so only a count for each
    block is gathered and summed up; the rows are read a second time and stay where they are. The
    counts are broadcast up to ``MAX_RUNS`` blocks and joined as the engine sees fit beyond.
    """
    block = ["_file", "_block"]
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    counts = placed.groupBy(*block).agg(F.min("_line").alias("_first"), F.count("*").alias("_rows"))
    runs = materialize(counts, "blocks")
    before = F.sum("_rows").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select(*block, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    if runs.count() <= MAX_RUNS:
        shifts = F.broadcast(shifts)
    numbered = placed.join(shifts, block).withColumn("row_id", F.col("_line") + F.col("_shift"))
    return numbered.drop(*block, "_line", "_shift")


def read_raw_pairs(
    spark: SparkSession,
    path: str | list[str],
    schema: str | None = None,
    pandas_missing: bool = False,
    multiline: bool = True,
) -> DataFrame:
    """(row_id, paraphrased_question, sparql_wikidata) from raw CSV; other columns are not parsed.

    Rows are numbered by file name and place in the file.
    """
    columns = ["row_id", QUESTION_SOURCE, QUERY_SOURCE]
    if not multiline:
        raw = read_csv(spark, path, schema, pandas_missing, multiline=False)
        return number_rows(raw.select(*columns[1:], "_metadata")).select(*columns)
    raw = read_csv_blocks(spark, path, schema, row_id="row_id").select(*columns)
    return _missing(raw) if pandas_missing else raw


def literal_pairs(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """(row_id, question, org_sparql) from rows written out in a program."""
    numbered = [(i, q, s) for i, (q, s) in enumerate(rows)]
    return spark.createDataFrame(numbered, "row_id long, question string, org_sparql string")


def rename_pairs(df: DataFrame) -> DataFrame:
    """The two used columns under their working names, with every key column kept."""
    keys = [c for c in ("row_id", "split") if c in df.columns]
    return df.select(*keys, QUESTION_SOURCE, QUERY_SOURCE).withColumnsRenamed(
        {QUESTION_SOURCE: "question", QUERY_SOURCE: "sparql"}
    )

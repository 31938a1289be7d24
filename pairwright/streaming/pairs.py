"""The row-wise steps on a stream of pairs: prompts, ids to labels, labels to ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairwright.functions.prompt import render_prompt
from pairwright.operators.rewrite import decode_labels_inline, encode_ids_inline


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of pairs (question, sparql, …) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def prompt_stream(pairs: DataFrame, dictionary: DataFrame, mode: str = "train") -> DataFrame:
    """Encode ids and render prompts, without state and without a shuffle.

    ``dictionary`` is a finished table of checked, small size.
    """
    encoded = encode_ids_inline(pairs, dictionary)
    return encoded.withColumn("org_text", render_prompt(mode, F.col("question"), F.col("sparql_modf")))


def decode_stream(texts: DataFrame, dictionary: DataFrame, text: str = "sparql_modf") -> DataFrame:
    return decode_labels_inline(texts, dictionary, text)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; ``once`` stops after what is there now."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()

"""From raw train and test pairs to a dictionary, encoded pairs, splits and token tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.config import Settings
from pairwright.functions.prompt import render_prompt
from pairwright.operators.dictionary import all_queries, build_dictionary
from pairwright.operators.index import contiguous_index
from pairwright.operators.preview import batch_numbers, observe_rows
from pairwright.operators.rewrite import encode_ids
from pairwright.operators.split import exact_split, shuffle_key
from pairwright.operators.tokens import tokenize
from pairwright.sources.batch_table import read_token_batches, write_token_batches
from pairwright.sources.dictionary_files import read_dictionary, write_dictionary
from pairwright.sources.pairs import write_csv
from pairwright.sources.vocabulary import Vocabulary
from pairwright.workspace import materialize, released


@dataclass(frozen=True)
class Prepared:
    """The tables, and rows and batches of each split, counted while the tokens were written."""

    dictionary: DataFrame
    pairs: DataFrame
    tokens: DataFrame
    rows: dict[str, int]
    batches: dict[str, int]


def split_pairs(train: DataFrame, test: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All pairs with ``split`` (train, val, test) and ``place``, their sort key in the split.

    Train and validation rows are in shuffled order, test rows in file order.
    """
    kept, held_out = exact_split(train, "row_id", settings.valid_fraction, settings.split_seed)
    order = shuffle_key("row_id", settings.split_seed)
    parts = [
        kept.select("*", F.lit("train").alias("split"), order.alias("place")),
        held_out.select("*", F.lit("val").alias("split"), order.alias("place")),
        test.select("*", F.lit("test").alias("split"), F.lit("").alias("place")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def encode_pairs(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(row_id, split, question, sparql, sparql_modf, …); ``row_id`` is unique per split."""
    return encode_ids(pairs, dictionary, row_key=["split", "row_id"])


def token_records(
    pairs: DataFrame,
    vocabulary: Vocabulary,
    null_text: str | None = None,
    on_special: str = "error",
) -> DataFrame:
    """Train-mode prompts of every split as (split, ord, row_id, org_text, encoded_text, decoded_text)."""
    prompts = pairs.select(
        "split",
        "ord",
        "row_id",
        render_prompt("train", F.col("question"), F.col("sparql_modf"), null_text).alias("org_text"),
    )
    return tokenize(prompts, vocabulary, on_special=on_special)


def prepare(
    train: DataFrame,
    test: DataFrame,
    vocabulary: Vocabulary,
    out: str,
    settings: Settings = Settings(),
    null_text: str | None = None,
    csv: bool = False,
) -> Prepared:
    """Run the whole preparation and write its tables below ``out``; nothing else stays behind."""
    with released(train.sparkSession):
        return _prepare(train, test, vocabulary, out, settings, null_text, csv)


def _prepare(
    train: DataFrame,
    test: DataFrame,
    vocabulary: Vocabulary,
    out: str,
    settings: Settings,
    null_text: str | None,
    csv: bool,
) -> Prepared:
    spark = train.sparkSession
    dictionary = materialize(build_dictionary(all_queries(train, test)), "dictionary")
    write_dictionary(dictionary, f"{out}/dictionary")
    parted = split_pairs(train, test, settings)
    renamed = parted.withColumnsRenamed({"paraphrased_question": "question", "sparql_wikidata": "sparql"})
    numbered = contiguous_index(renamed, ["place", "row_id"], ["split"], row_key=["split", "row_id"])
    encoded = encode_pairs(numbered, dictionary)
    columns = ["split", "ord", "row_id", "question", "sparql", "sparql_modf"]
    encoded.select(*columns).write.partitionBy("split").parquet(f"{out}/pairs")
    pairs = spark.read.schema(encoded.select(*columns).schema).parquet(f"{out}/pairs")
    if csv:
        for split in ("train", "val", "test"):
            rows = pairs.where(F.col("split") == split).select("question", "sparql", "sparql_modf")
            write_csv(rows, f"{out}/csv/{split}")
    records, counted = observe_rows(token_records(pairs, vocabulary, null_text), list(settings.batch_sizes))
    write_token_batches(records, f"{out}/tokens", settings)
    rows = counted.get
    tokens = read_token_batches(spark, f"{out}/tokens")
    batches = batch_numbers(rows, settings.batch_sizes)
    return Prepared(read_dictionary(spark, f"{out}/dictionary"), pairs, tokens, rows, batches)

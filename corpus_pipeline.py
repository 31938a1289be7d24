"""From raw documents to packed sequences, in stages that each apply one operator.

Every function takes (spark, docs, sf_dir), works on all rows it is given, and returns the columns
of documents, but for the last, which returns pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import decontaminate, language, packing, pii, simhash
from pairwright.llm.queries import VOCABULARY, table
from pairwright.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; ``und`` (null, or no letter) goes.

    Where no document has a language to learn from, nothing is judged and all documents stay.
    """
    model = language.fit_language(docs)
    if not model.labels:
        return _columns(docs)
    found = language.identify(_columns(docs), model)
    return _columns(found.where(F.col("language.pred") != language.UNDETERMINED))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of three-word shingles that
    are linked at two differing bits or fewer.

    Rows are chosen, not ids: a row is its id and a hash of all columns, and the least row of a
    group stays, so that of the smallest id. Of rows alike in all columns one stays. Rows without
    an id are in no group and all stay.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64(*COLUMNS).alias("hash")))
    rows = _columns(docs).withColumn("row", row)
    found = simhash.near_duplicates(rows, id_column="row")
    first = found.where(F.col("row") == F.col("component")).select("row").distinct()
    named = rows.join(first, "row", "left_semi").dropDuplicates(["row"])
    return _columns(named).unionByName(_columns(docs).where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.scan_documents(_columns(docs), table(spark, sf_dir, "benchmark"))
    return _columns(found.where(F.size("passages.hits") == 0))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in brackets in the place of each span of personal data."""
    cleaned = pii.redact(_columns(docs), pii.fit_pii(docs))
    return _columns(cleaned.withColumn("n_chars", F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(_columns(docs), public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The fingerprints, the language model and the merges are beyond SQL: the tests hold the stages
#: against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

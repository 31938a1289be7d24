"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from pairwright.llm import decontaminate, language, licences, mil, packing, pii, pitman_yor, quality_rules, simhash, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " \n\t", "!!! ***", "one two three four five", "one two three four five", "mail a.b@c.example.org or +1 (555) 010-0199",
         "Wörter mit Größe und Straße", "word " * 30_000, "x" * 100_000]
SCHEMA = "doc_id long, text string, lang string, score double, words int, n_words int, pred string, first int, row int, id int, fp long, key long"


def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", 0.5, 1, 2, "p", 3, 4, 5, 6, 7) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, None, None, None, None, None, None, None)] * 2 if texts else []
    rows += rows[4:5] * 2
    return spark.createDataFrame(rows, SCHEMA)


def language_of(df):
    return language.identify(df, language.fit_language(df))


def quality_of(df):
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return mil.score_quality(df, mil.fit_quality(df, labels))


def passages_of(df):
    items = df.sparkSession.createDataFrame([(1, "two three four"), (2, None), (None, "one"), (3, "")], "item_id long, text string")
    return decontaminate.scan_documents(df, items)


def scores_of(df):
    rows = df.select(F.col("doc_id").alias("id"), "text", F.lit(True).alias("train"))
    small = pitman_yor.PitmanYorSettings(order=2, burn_in=0, samples=1, markers=4, classes=2)
    return pitman_yor.score_texts(rows, small)


OPERATORS = {
    "quality": quality_of,
    "scores": scores_of,
    "near_duplicates": simhash.near_duplicates,
    "token_counts": lambda df: token_counts.count_tokens(df, PATH, 1024),
    "pii": lambda df: pii.find_pii(df, pii.fit_pii(df)),
    "decontamination": passages_of,
    "licences": licences.scan_licences,
    "rules": quality_rules.ledger,
    "language": language_of,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name):
    df = docs(spark, TEXTS)
    assert len(OPERATORS[name](df).collect()) == df.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_none(spark, name):
    assert OPERATORS[name](docs(spark, [])).collect() == []


def test_packing_of_edges(spark):
    rows = packing.pack(docs(spark, TEXTS), PATH).collect()
    assert len({r["doc_id"] for r in rows}) == len(TEXTS) + 1
    assert packing.pack(docs(spark, []), PATH).collect() == []
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_defined_results_of_null_and_empty(spark):
    df = docs(spark, TEXTS)
    for r in language_of(df).where("doc_id < 4").collect():
        assert (r["language"]["pred"], r["language"]["score"]) == ("und", 0.0)
    assert {r["fail_bits"] & 65 for r in quality_rules.ledger(df).where("doc_id < 3").collect()} == {65}
    assert {r["n_tokens"] for r in OPERATORS["token_counts"](df).where("doc_id < 2").collect()} == {0}
    found = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(df).collect()}
    assert [found[i] for i in (0, 1, 2, 3, 5, None)] == [0, 0, 0, 3, 4, None]

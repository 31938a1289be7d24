"""The stages of the pipeline against plain Python, on a small table with hard rows."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pairwright.llm import decontaminate, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def windows(text, width):
    words = decontaminate.normalised(text).split()
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))] if words else []


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    real = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = [tuple(r) for r in real]
    extra = [None, "", "12 34 !!", rows[3][1], rows[3][1], "write to a.b@c.example.org"]
    rows += [(1000 + i, t, "en", None, len(t or "")) for i, t in enumerate(extra)]
    rows += [(None, "a text without an id", None, None, None), rows[5], rows[5]]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_columns_and_clean_rows(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    letters = [r for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    assert len(letters) - kept.count() <= len(letters) // 50
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in kept.collect())

    single = stages["near_duplicates"](spark, kept, SF)
    texts = [r["text"] for r in single.where("doc_id is not null").collect()]
    assert len(texts) == len(set(texts)) and single.where("doc_id is null").count() == 1
    assert len({r["doc_id"] for r in single.collect()}) == single.count()

    clean = stages["decontamination"](spark, single, SF)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = [w for t in items for w in windows(t, 10)]
    hit = {r["doc_id"] for r in single.collect() if any(w in decontaminate.normalised(r["text"]) for w in known)}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - hit and hit

    redacted = stages["personal_data"](spark, clean, SF)
    assert redacted.count() == clean.count()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in redacted.collect():
        assert pii.base_spans(r["text"]) == []
        assert r["text"] == before[r["doc_id"]] or "[" in r["text"]

    packed = stages["packing"](spark, redacted, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in redacted.collect()}
    found = {}
    for r in packed:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == sizes


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_an_empty_table_goes_through(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], SCHEMA), SF).collect() == []


def test_without_languages_nothing_is_rejected(spark):
    rows = [(1, "some text", None, "a", 9), (2, None, None, None, None), (None, "12 34", None, "b", 5)]
    got = dict(corpus_pipeline.STAGES)["language"](spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.createDataFrame(rows, SCHEMA).collect()))


def test_rows_of_one_id_are_judged_by_row(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "en", "a", 1), (1, "quite another text of other words", "en", "a", 1), (2, text, "de", "b", 2),
            (1, text, "en", "a", 1), (None, text, "en", None, None), (None, text, "en", None, None)]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, text), (0, text), (1, text), (1, "quite another text of other words")]

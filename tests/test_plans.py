"""The three chains end to end on a small corpus, and the row-wise steps on a stream."""

import math
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.config import Settings
from pairwright.functions.prompt import render_prompt
from pairwright.operators.generate import next_token_table, table_scorer
from pairwright.operators.preview import RowCounts, batch_numbers, observe_rows, observe_stream
from pairwright.plans.evaluate import model_inputs, model_loss
from pairwright.plans.infer import answer
from pairwright.plans.prepare import prepare
from pairwright.sources.pairs import literal_pairs, read_csv
from pairwright.sources.vocabulary import get_vocabulary
from pairwright.streaming.pairs import decode_stream, prompt_stream, read_stream, write_stream

RAW = "row_id long, paraphrased_question string, sparql_wikidata string"


@pytest.fixture(scope="module")
def vocabulary(spark):
    return get_vocabulary(spark, "bytes")


@pytest.fixture(scope="module")
def prepared(spark, vocabulary, tmp_path_factory):
    rows = [(i, f"Who is {i}?", f"SELECT ?x {{ wd:Q{i % 20} wdt:P{i % 3} ?x }}") for i in range(60)]
    rows[5] = (5, None, None)
    train = spark.createDataFrame(rows[:45], RAW)
    test = spark.createDataFrame([(i - 45, q, s) for i, q, s in rows[45:]], RAW).repartition(3)
    out = str(tmp_path_factory.mktemp("prepared"))
    return prepare(train, test, vocabulary, out, csv=True), out, rows


def test_prepare(spark, prepared):
    made, out, rows = prepared
    assert made.dictionary.count() == 24
    sizes = {r["split"]: r["n"] for r in made.tokens.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 40, "val": 5, "test": 15} == made.rows
    assert made.batches == {"train": 5, "val": 2, "test": 4}
    for split, n in sizes.items():
        ords = [r["ord"] for r in made.tokens.where(F.col("split") == split).select("ord").orderBy("ord").collect()]
        assert ords == list(range(n))
    test = made.pairs.where("split = 'test'").orderBy("ord").collect()
    assert [r["question"] for r in test] == [q for _, q, _ in rows[45:]]
    assert all("ENTITY_" in r["sparql_modf"] and "wd" not in r["sparql_modf"] for r in test)
    record = made.tokens.where("split = 'test' and ord = 0").first()
    expected = f"Question → SPARQL:\nQuestion: Who is 45?\nSPARQL: {test[0]['sparql_modf']}"
    assert record["org_text"] == expected
    assert bytes(record["encoded_text"]).decode() == expected
    assert len(record["decoded_text"]) == len(record["encoded_text"])
    csv = read_csv(spark, f"{out}/csv/val", "question string, sparql string, sparql_modf string")
    assert csv.count() == 5


def test_prepare_leaves_nothing_in_the_shared_folder(spark, vocabulary, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "pairwright"
    before = set(shared.iterdir())
    pairs = spark.createDataFrame([(i, f"q{i}", f"ASK {{ wd:Q{i} }}") for i in range(12)], RAW)
    made = prepare(pairs, pairs, vocabulary, str(tmp_path / "out"))
    assert made.tokens.count() == 24 and made.dictionary.count() == 13
    assert set(shared.iterdir()) == before


def test_only_the_folder_of_a_split_is_read(prepared, plan_of):
    made, *_ = prepared
    assert "PartitionFilters: [isnotnull(split" in plan_of(made.tokens.where("split = 'val'"))


def test_evaluate(prepared):
    made, *_ = prepared
    uniform = lambda: lambda rows: [np.zeros((len(r), 50257)) for r in rows]
    assert model_inputs(made.tokens, "val").select("batch_id").distinct().count() == 2
    loss = model_loss(made.tokens, "val", uniform).first()["loss"]
    assert loss == pytest.approx(math.log(50257))
    assert math.isnan(model_loss(made.tokens.where("ord < 0"), "val", uniform).first()["loss"])


def test_infer(spark, prepared, vocabulary):
    made, *_ = prepared
    scorer = table_scorer(next_token_table(made.tokens))
    questions = literal_pairs(spark, [("What of ENTITY_01?", "ASK"), ("Who?", "SELECT")])
    got = answer(questions, vocabulary, scorer, made.dictionary, settings=Settings(max_new_tokens=5))
    rows = got.orderBy("row_id").collect()
    assert [r["org_sparql"] for r in rows] == ["ASK", "SELECT"]
    first = {r["label"]: r["eid"] for r in made.dictionary.collect()}["ENTITY_01"]
    assert rows[0]["decoded_text"].startswith("Question → SPARQL:\nQuestion: What of ENTITY_01?")
    assert rows[0]["decoded_sparql"].startswith(f"Question → SPARQL:\nQuestion: What of {first}?")


def test_stream_gives_what_a_batch_gives(spark, prepared, tmp_path):
    made, out, _ = prepared
    columns = ["row_id", "question", "sparql"]
    source = str(tmp_path / "source")
    made.pairs.select(*columns).repartition(4).write.parquet(source)
    schema = "row_id long, question string, sparql string"
    pairs = read_stream(spark, source, schema, files_per_batch=2)
    query = write_stream(
        decode_stream(prompt_stream(pairs, made.dictionary), made.dictionary),
        str(tmp_path / "sink"),
        str(tmp_path / "state"),
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "sink"))
    prompt = render_prompt("train", F.col("question"), F.col("sparql_modf"))
    expected = made.pairs.select("question", "sparql", prompt.alias("org_text"), F.col("sparql").alias("decoded_sparql"))
    order = ["org_text", "sparql"]
    assert got.select(expected.columns).orderBy(*order).collect() == expected.orderBy(*order).collect()


def test_collating_prepared_tokens_needs_no_exchange(prepared, plan_of):
    made, *_ = prepared
    assert "Exchange" not in plan_of(model_inputs(made.tokens, "train"))


def test_counts_take_no_scan_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train" if i % 3 else "val") for i in range(50)], "i long, split string")
    counted, found = observe_rows(rows, ["train", "val", "test"])
    spark.sparkContext.setJobGroup("observed", "observed")
    counted.write.parquet(str(tmp_path / "t"))
    assert found.get == {"train": 33, "val": 17, "test": 0}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert batch_numbers(found.get, {"train": 8, "val": 4, "test": 4}) == {"train": 5, "val": 5, "test": 0}


def test_counts_of_a_stream(spark, tmp_path):
    schema = "i long, split string"
    rows = spark.createDataFrame([(i, "train" if i % 3 else "val") for i in range(50)], schema)
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = RowCounts()
    spark.streams.addListener(counts)
    try:
        stream = observe_stream(read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1), ["train", "val"])
        write_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        for _ in range(100):
            if sum(counts.counts.values()) == 100:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    assert counts.counts == {"train": 66, "val": 34}

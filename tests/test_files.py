import json
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from pairwright.operators.preview import first_rows, record_at, shape
from pairwright.sources.dictionary_files import read_dictionary, read_flat_object, write_dictionary
from pairwright.sources.pairs import literal_pairs, read_csv, read_raw_pairs, rename_pairs, write_csv
from pairwright.sources.token_table import SCHEMA, read_tokens, write_tokens
from pairwright.workspace import fresh_path, materialize, release, released, shared_root

FIELDS = ["a,b", "line\nbreak", 'say "hi"', "", "NA", "back\\slash", "  edges  ", "crlf\r\nend", "é→"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(i, f, "x") for i, f in enumerate(FIELDS)]
    path = str(tmp_path / "out")
    write_csv(spark.createDataFrame(rows, "id long, t string, u string").coalesce(1), path)
    back = read_csv(spark, path, "id long, t string, u string").orderBy("id").collect()
    assert [r["t"] for r in back] == [f or None for f in FIELDS]
    missing = read_csv(spark, path, "id long, t string, u string", pandas_missing=True).orderBy("id").collect()
    assert [r["t"] for r in missing] == [None if f in ("", "NA") else f for f in FIELDS]


def test_tokens_are_written_without_a_sort_by_split(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before, write = spark.conf.get(name), DataFrameWriter.parquet

    def noted(self, *args, **kwargs):
        seen.append(int(spark.conf.get(name)))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    rows = [(i, i // 3, "t", [i, i], ["a", "b"], ("train", "val", "test")[i % 3]) for i in range(60)]
    write_tokens(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "tokens"))
    assert seen[0] >= 3 and spark.conf.get(name) == before
    back = read_tokens(spark, str(tmp_path / "tokens")).select("row_id", "ord", "org_text", "encoded_text", "decoded_text", "split")
    assert sorted(map(tuple, back.collect())) == rows


def test_raw_pairs_keep_file_order(spark, tmp_path):
    for part in range(3):
        lines = ["uid,paraphrased_question,other,sparql_wikidata"]
        lines += [f'{i},"q {part}, {i}",z,"SELECT\nwd:Q{i}"' for i in range(40)]
        (tmp_path / f"train-{part}.csv").write_text("\n".join(lines) + "\n")
    raw = read_raw_pairs(spark, str(tmp_path))
    rows = raw.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(120))
    assert [r["paraphrased_question"] for r in rows] == [f"q {p}, {i}" for p in range(3) for i in range(40)]
    assert rows[41]["sparql_wikidata"] == "SELECT\nwd:Q1"
    assert rename_pairs(raw).columns == ["row_id", "question", "sparql"]


def test_numbering_moves_no_text(spark, tmp_path, plan_of):
    rows = [(f"q {i}", f"s {i}") for i in range(4000)]
    columns = "paraphrased_question string, sparql_wikidata string"
    source = spark.createDataFrame(rows, columns).coalesce(1).sortWithinPartitions(F.length("sparql_wikidata"), "sparql_wikidata")
    write_csv(source, str(tmp_path / "raw"), max_rows_per_file=1500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = read_raw_pairs(spark, str(tmp_path / "raw"), multiline=False)
        assert raw.rdd.getNumPartitions() > 3
        got = [r["sparql_wikidata"] for r in raw.orderBy("row_id").collect()]
        assert [r["row_id"] for r in raw.select("row_id").orderBy("row_id").collect()] == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"s {i}" for i in range(4000)]
    plan = plan_of(raw)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not any("Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line for line in plan.split("\n"))


def test_dictionary_files(spark, tmp_path):
    table = {"wd:Q1": "ENTITY_1", "wd:Q2": "ENTITY_2", "ENTITY_UNK": "ENTITY_0", 'odd "}': "b, {c}"}
    df = spark.createDataFrame(list(table.items()), "eid string, label string")
    write_dictionary(df, str(tmp_path / "lines"))
    assert {r["eid"]: r["label"] for r in read_dictionary(spark, str(tmp_path / "lines")).collect()} == table
    for indent in (2, None):
        path = tmp_path / f"flat{indent}.json"
        path.write_text(json.dumps(table, indent=indent))
        assert {r["eid"]: r["label"] for r in read_flat_object(spark, str(path)).collect()} == table
        path.write_text(json.dumps({v: k for k, v in table.items()}, indent=indent))
        assert {r["eid"]: r["label"] for r in read_flat_object(spark, str(path), "label").collect()} == table


def test_literal_rows_and_preview(spark):
    df = literal_pairs(spark, [("q0", "s0"), ("q1", "s1"), ("q2", "s2")])
    size = shape(df).first()
    assert (size["n_rows"], size["n_columns"]) == (3, 3)
    assert [r["question"] for r in first_rows(df, ["row_id"], 2).collect()] == ["q0", "q1"]
    assert record_at(df, 2, "row_id").first()["org_sparql"] == "s2"


def test_workspace_uses_the_session_s_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(root)
    kept = materialize(spark.range(5), "five")
    assert kept.count() == 5 and kept.inputFiles()[0].removeprefix("file://").startswith(root)
    assert release(spark) > 0
    with pytest.raises(Exception):
        kept.agg(F.sum("id")).collect()


def test_workspace_wants_a_shared_folder_outside_local_mode():
    held = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: None),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]"),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(held)


def test_a_plan_s_tables_are_released(spark):
    outer = materialize(spark.range(3), "outer")
    with released(spark):
        inner = materialize(spark.range(4), "inner")
        assert inner.count() == 4
    assert outer.count() == 3
    with pytest.raises(Exception):
        inner.agg(F.sum("id")).collect()
    release(spark)

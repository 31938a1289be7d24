"""All lookup plans give the same answers, also when one key holds a third of all places."""

import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators.lookup import KeyTable, lookup, lookup_held

PLANS = {
    "broadcast": lambda df, table: lookup(df, "keys", table),
    "broadcast by key": lambda df, table: lookup(df, "keys", table, row_key=["id"]),
    "joined": lambda df, table: lookup(df, "keys", table, broadcast_bytes=0),
    "joined by key": lambda df, table: lookup(df, "keys", table, row_key=["id"], broadcast_bytes=0, salts=3),
    "joined, one salt": lambda df, table: lookup(df, "keys", table, broadcast_bytes=0, salts=1),
    "held": lambda df, table: lookup_held(df, "keys", table),
}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(3)
    values = {f"k{i}": f"v{i}" for i in range(500)}
    rows = []
    for i in range(300):
        keys = ["k0" if rng.random() < 0.33 else f"k{rng.randrange(600)}" for _ in range(rng.randrange(12))]
        if i % 9 == 0:
            keys.append(None)
        rows.append((i, f"row {i}", keys))
    rows += [(1000, "null keys", None), (1001, "only null", [None, None]), (1002, "no keys", [])]
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.createDataFrame(rows, "id long, name string, keys array<string>").write.parquet(path)
    table = spark.createDataFrame(list(values.items()), "k string, v string")
    expected = {
        (i, name): None if keys is None else [(k, values.get(k)) for k in keys] for i, name, keys in rows
    }
    return spark.read.parquet(path), KeyTable(table, "k", "v"), expected


def answers(df):
    return {
        (r["id"], r["name"]): None if r["pairs"] is None else [(p["key"], p["value"]) for p in r["pairs"]]
        for r in df.collect()
    }


@pytest.mark.parametrize("plan", PLANS)
def test_every_plan(data, plan):
    frame, table, expected = data
    found = PLANS[plan](frame, table)
    assert answers(found) == expected and found.columns == ["id", "name", "pairs"]


@pytest.mark.parametrize("plan", PLANS)
def test_empty_tables(data, plan):
    frame, table, expected = data
    assert answers(PLANS[plan](frame.limit(0), table)) == {}
    nothing = KeyTable(table.frame.limit(0), "k", "v")
    blank = {row: None if pairs is None else [(k, None) for k, _ in pairs] for row, pairs in expected.items()}
    assert answers(PLANS[plan](frame, nothing)) == blank


def test_rows_without_keys_are_not_moved(data, plan_of):
    frame, table, _ = data
    for limit in (1 << 20, 0):
        plan = plan_of(lookup(frame, "keys", table, row_key=["id"], broadcast_bytes=limit))
        union = next(i for i, line in enumerate(plan.split("\n")) if "Union" in line)
        branch = plan.split("\n")[union + 1 :]
        depth = branch[0].index(":") if ":" in branch[0] else len(branch[0]) - len(branch[0].lstrip(" +-"))
        first = []
        for line in branch[1:]:
            if line.lstrip(" ").startswith("+- ") and line.index("+") <= depth:
                break
            first.append(line)
        assert not any("Exchange" in line for line in first) and any("FileScan" in line for line in first)
        assert ("BroadcastHashJoin" in plan) or not limit


@pytest.mark.parametrize("plan", ["broadcast", "joined", "held"])
def test_null_and_repeated_row_keys(spark, plan):
    rows = [(1, ["a"]), (1, ["b", "c"]), (None, ["a"]), (None, None), (None, ["z"])]
    frame = spark.createDataFrame(rows, "id long, keys array<string>")
    table = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string")
    held = {"a": "1", "b": "2", "c": "3"}
    want = sorted((str(i), str(k and [(x, held.get(x)) for x in k])) for i, k in rows)
    got = PLANS[plan](frame, KeyTable(table, "k", "v")).collect()
    assert sorted((str(r["id"]), str(r["pairs"] and [tuple(p) for p in r["pairs"]])) for r in got) == want


@pytest.mark.parametrize("rows", [[(1, ["a"]), (1, ["b"])], [(None, ["a"])]])
@pytest.mark.parametrize("plan", ["broadcast by key", "joined by key"])
def test_a_row_key_has_to_tell_rows_apart(spark, plan, rows):
    frame = spark.createDataFrame(rows, "id long, keys array<string>")
    table = KeyTable(spark.createDataFrame([("a", "1")], "k string, v string"), "k", "v")
    with pytest.raises(Exception, match="id: null, or the same in several rows"):
        PLANS[plan](frame, table).collect()


@pytest.mark.parametrize("plan", PLANS)
def test_a_repeated_table_key_is_an_error(spark, plan):
    frame = spark.createDataFrame([(1, ["a"])], "id long, keys array<string>")
    table = KeyTable(spark.createDataFrame([("a", "1"), ("a", "9")], "k string, v string"), "k", "v")
    with pytest.raises(Exception, match="repeats the key a"):
        PLANS[plan](frame, table).collect()


def test_a_table_too_large_to_hold(data):
    frame, table, _ = data
    assert table.bytes() > 500 * 32
    with pytest.raises(ValueError, match="too large"):
        lookup_held(frame, "keys", table, most_bytes=500 * 32)
    assert frame.where(F.size("keys") > 0).count() > 200


def test_what_makes_the_rows_runs_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    kind = "id long, keys array<string>"
    rows = spark.createDataFrame([(i, ["a", "b"] if i % 2 else []) for i in range(30)], kind).mapInArrow(counted, kind)
    held = KeyTable(spark.createDataFrame([("a", "x")], "key string, value string"), "key", "value")
    got = lookup(rows, "keys", held).collect()
    assert len(got) == 30 and runs.value == 30
    assert {len(r["pairs"]) for r in got} == {0, 2}

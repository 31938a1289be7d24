"""Collation against hand-written rows and against a plain loop."""

import random

import pandas as pd
import pytest

from pairwright.config import Settings
from pairwright.operators.batches import (
    batch_count,
    batch_stats,
    collate,
    collate_with,
    export_batches,
    load_batches,
)

P, END = 50256, "<|endoftext|>"


def tokens(spark, rows, split="test"):
    made = [(i, f"t{i}", ids, [str(x) for x in ids], split) for i, ids in enumerate(rows)]
    return spark.createDataFrame(
        made, "ord long, org_text string, encoded_text array<int>, decoded_text array<string>, split string"
    )


def by_loop(batch, limit):
    width = max(len(ids) + 1 for ids in batch)
    out = []
    for ids in batch:
        padded = ids + [P] * (width - len(ids))
        inputs, targets = padded[:-1], padded[1:]
        seen = False
        for i, v in enumerate(targets):
            if v == P:
                targets[i] = -100 if seen else P
                seen = True
        out.append((inputs[:limit], targets[:limit]))
    return out


def test_written_rows(spark):
    settings = Settings(batch_sizes={"test": 2})
    rows = collate(load_batches(tokens(spark, [[1, 2, 3, 4], [5, 6], [], [7]]), "test", settings), settings)
    got = [(r["batch_id"], r["inputs"], r["targets"]) for r in rows.orderBy("ord").collect()]
    assert got == [
        (0, [1, 2, 3, 4], [2, 3, 4, P]),
        (0, [5, 6, P, P], [6, P, -100, -100]),
        (1, [P], [P]),
        (1, [7], [P]),
    ]


@pytest.mark.parametrize("limit", [None, 6])
def test_random_rows_match_the_loop(spark, limit):
    rng = random.Random(4)
    rows = [[rng.choice([1, 2, 3, P]) for _ in range(rng.randrange(12))] for _ in range(43)]
    settings = Settings(max_length=limit)
    df = tokens(spark, rows, "train").repartition(7)
    got = collate(load_batches(df, "train", settings), settings, texts=True).orderBy("ord").collect()
    expected = [pair for i in range(0, 43, 8) for pair in by_loop(rows[i : i + 8], limit)]
    assert [(r["inputs"], r["targets"]) for r in got] == expected
    for i, r in enumerate(got):
        width = max(len(x) + 1 for x in rows[i // 8 * 8 : i // 8 * 8 + 8])
        text = [str(x) for x in rows[i]] + [END] * (width - len(rows[i]))
        assert r["inputs_txt"] == text and r["targets_txt"] == text[1:]
        assert len(r["inputs"]) == len(r["targets"])


def test_sizes_by_split(spark):
    settings = Settings()
    assert [settings.batch_size(s) for s in ("train", "val", "test")] == [8, 4, 4]
    with pytest.raises(NotImplementedError):
        settings.batch_size("dev")
    df = tokens(spark, [[1]] * 9)
    assert batch_count(df, 4).first()["n_batches"] == 3
    assert load_batches(df, "test").groupBy("batch_id").count().count() == 3


def test_stats_and_export(spark):
    batches = load_batches(tokens(spark, [[1, 2], [3], [4, 5, 6], [], [7]]), "test")
    stats = {r["batch_id"]: (r["n_rows"], r["n_tokens"], r["padded_length"]) for r in batch_stats(batches).collect()}
    assert stats == {0: (4, 6, 4), 1: (1, 1, 2)}
    out = {r["batch_id"]: r["inputs"] for r in export_batches(collate(batches)).collect()}
    assert out == {0: [[1, 2, P], [3, P, P], [4, 5, 6], [P, P, P]], 1: [[7]]}


def test_a_function_of_one_s_own(spark):
    def longest(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch_id": frame["batch_id"][:1], "n": [frame["encoded_text"].map(len).max()]})

    batches = load_batches(tokens(spark, [[1, 2], [3], [4, 5, 6], [], [7]]), "test")
    got = collate_with(batches, longest, "batch_id long, n long").orderBy("batch_id").collect()
    assert [r["n"] for r in got] == [3, 1]


def test_one_exchange_by_batch(spark, plan_of):
    plan = plan_of(collate(load_batches(tokens(spark, [[1]]), "test"), texts=True))
    assert plan.count("Exchange hashpartitioning(batch_id") == 1 and "SinglePartition" not in plan

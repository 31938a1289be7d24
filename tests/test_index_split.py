"""Numbering and splitting do not depend on how rows are partitioned."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pairwright.operators.index import contiguous_index
from pairwright.operators.split import exact_split, split_at


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_numbers_follow_the_order_within_groups(spark, partitions):
    rows = [("abc"[i % 3 if i % 7 else 0], (i * 7919) % 1009, f"t{i}") for i in range(1009)]
    df = spark.createDataFrame(rows, "g string, k long, t string").repartition(partitions)
    got = {(r["g"], r["k"]): r["ord"] for r in contiguous_index(df, ["k"], within=["g"]).collect()}
    for g in "abc":
        keys = sorted(k for h, k, _ in rows if h == g)
        assert [got[g, k] for k in keys] == list(range(len(keys)))
    apart = contiguous_index(df, ["k"], within=["g"], row_key=["t"])
    assert {(r["g"], r["k"]): r["ord"] for r in apart.collect()} == got and apart.columns == [*df.columns, "ord"]
    whole = contiguous_index(df, ["g", "k"], name="n")
    assert [r["n"] for r in whole.orderBy("g", "k").collect()] == list(range(len(rows)))
    assert whole.columns == ["g", "k", "t", "n"]


def test_many_groups_are_numbered_without_the_driver(spark, monkeypatch, plan_of):
    df = spark.range(300).selectExpr("id % 90 AS g", "id AS k").repartition(5)
    expected = sorted((i % 90, i, i // 90) for i in range(300))
    assert sorted(map(tuple, contiguous_index(df, ["k"], within=["g"]).collect())) == expected
    monkeypatch.setattr("pairwright.operators.index.MAX_RUNS", 3)
    apart = contiguous_index(df, ["k"], within=["g"])
    assert sorted(map(tuple, apart.collect())) == expected
    assert "SinglePartition" not in plan_of(apart)


def test_nothing_to_number(spark):
    assert contiguous_index(spark.range(0), ["id"]).collect() == []


@pytest.mark.parametrize("n", [2, 10, 101, 1000])
def test_split_is_exact_and_follows_the_hash(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    train, valid = exact_split(df, "row_id")
    kept = {r[0] for r in train.collect()}
    held = {r[0] for r in valid.collect()}
    assert len(held) == math.ceil(n * 0.1) and kept | held == set(range(n)) and not kept & held
    ranked = sorted(range(n), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert held == set(ranked[: len(held)])


def test_split_of_too_few_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        exact_split(spark.range(1).withColumnRenamed("id", "row_id"))
    with pytest.raises(ValueError):
        exact_split(spark.range(0).withColumnRenamed("id", "row_id"))


def test_split_needs_no_shuffle_of_the_rows(spark, plan_of):
    df = spark.range(1000).withColumn("row_id", F.col("id"))
    train, valid = exact_split(df, "row_id")
    assert "Exchange" not in plan_of(train) and "Exchange" not in plan_of(valid)


def test_split_rejects_null_and_repeated_keys(spark):
    with pytest.raises(ValueError, match="have no k"):
        exact_split(spark.createDataFrame([(i if i > 2 else None,) for i in range(50)], "k long"), "k")
    with pytest.raises(ValueError, match="several rows"):
        exact_split(spark.createDataFrame([(1,)] * 50, "k long"), "k")


@pytest.mark.parametrize("digits,small", [(1, 1), (1, 7), (2, 3), (4, 10_000)])
def test_several_cuts_are_those_of_a_full_ranking(spark, monkeypatch, digits, small):
    monkeypatch.setattr("pairwright.operators.split._DIGITS", digits)
    n = 700
    df = spark.range(n).withColumnRenamed("id", "k").repartition(3)
    fractions = [0.01, 0.25, 0.0625, 0.5]
    parts = [[r[0] for r in p.collect()] for p in split_at(df, fractions, "k", seed=7, small=small)]
    ranked = sorted(range(n), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    bounds = [0, *(math.ceil(n * math.fsum(fractions[: i + 1])) for i in range(4)), n]
    assert [set(p) for p in parts] == [set(ranked[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    assert sum(map(len, parts)) == n


def test_ranking_is_bounded(spark, monkeypatch):
    """No group over the set size is ever ranked, and repeated keys are told before."""
    monkeypatch.setattr("pairwright.operators.split._DIGITS", 2)
    rows = [(1,)] * 30 + [(i,) for i in range(2, 40)]
    with pytest.raises(ValueError, match="several rows|rows have the k"):
        split_at(spark.createDataFrame(rows, "k long"), [0.0001, 0.2, 0.2, 0.2, 0.2, 0.1], "k", small=5)


def test_fractions_are_positive(spark):
    with pytest.raises(ValueError):
        split_at(spark.range(9), [], "id")
    with pytest.raises(ValueError):
        split_at(spark.range(9), [0.2, 0.0], "id")

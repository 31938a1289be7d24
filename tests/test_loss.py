import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions.arrays import argmax, keep_last, softmax
from pairwright.operators.loss import (
    batch_losses,
    checkpoint_losses,
    explode_positions,
    mean_of_batches,
    model_batch_losses,
    next_choice,
)
from pairwright.plans.evaluate import stored_loss

ROWS = [
    (0, [1.0, 2.0, 3.0], 2),
    (0, [1000.0, 0.0, 0.0], 0),
    (0, [0.0, 0.0, 0.0], -100),
    (1, [5.0, 5.0, 1.0], 1),
]


@pytest.fixture
def positions(spark):
    return spark.createDataFrame(ROWS, "batch_id long, logits array<double>, target int")


def test_mean_of_batch_means(positions):
    loss = mean_of_batches(batch_losses(positions)).first()["loss"]
    assert loss == pytest.approx(0.453033, abs=1e-6)


def test_nothing_to_average_is_nan(positions):
    assert math.isnan(mean_of_batches(batch_losses(positions.where("batch_id > 5"))).first()["loss"])
    ignored = positions.withColumn("target", F.when(F.col("batch_id") == 1, -100).otherwise(F.col("target")))
    losses = {r["batch_id"]: r["batch_loss"] for r in batch_losses(ignored).collect()}
    assert math.isnan(losses[1]) and not math.isnan(losses[0])
    assert math.isnan(mean_of_batches(batch_losses(ignored)).first()["loss"])


def test_rows_with_matrices_give_the_same(spark):
    rows = [
        (0, 0, [ROWS[0][1], ROWS[1][1]], [2, 0]),
        (0, 1, [ROWS[2][1]], [-100]),
        (1, 2, [ROWS[3][1]], [1]),
    ]
    scored = spark.createDataFrame(rows, "batch_id long, ord long, logits array<array<double>>, targets array<int>")
    assert stored_loss(scored).first()["loss"] == pytest.approx(0.453033, abs=1e-6)
    flat = explode_positions(scored.select("batch_id", "logits", "targets"))
    assert flat.columns == ["batch_id", "pos", "logits", "target"] and flat.count() == 4


def test_a_model_gives_what_its_logits_give(spark):
    rng = np.random.default_rng(0)
    table = rng.normal(size=(10, 10))
    rows = [(i // 4, i, list(map(int, rng.integers(0, 10, 6)))) for i in range(10)]
    rows = [(b, i, ids, [*ids[1:4], -100, -100, -100]) for b, i, ids in rows] + [(9, 99, [1, 2], [-100, -100])]
    collated = spark.createDataFrame(rows, "batch_id long, ord long, inputs array<int>, targets array<int>")
    model = lambda: lambda batch: [table[np.asarray(ids)] for ids in batch]
    got = {r["batch_id"]: r["batch_loss"] for r in model_batch_losses(collated, model).collect()}
    scored = spark.createDataFrame(
        [(b, [table[v].tolist() for v in ids], t) for b, _, ids, t in rows],
        "batch_id long, logits array<array<double>>, targets array<int>",
    )
    expected = {r["batch_id"]: r["batch_loss"] for r in batch_losses(explode_positions(scored)).collect()}
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, nan_ok=True)


def test_checkpoints(spark):
    rows = [(0, 0, "train", 1.0), (0, 0, "train", 2.0), (0, 0, "val", 4.0), (0, 3, "val", 9.0), (1, 500, "train", 0.5)]
    losses = spark.createDataFrame(rows, "epoch int, batch_id long, split string, batch_loss double")
    got = [r["report"] for r in checkpoint_losses(losses).orderBy("epoch").collect()]
    assert got == [
        "epoch 1, batch 000000: train 1.500000, validation 4.000000",
        "epoch 2, batch 000500: train 0.500000, validation nan",
    ]


def test_choices(spark):
    rows = [(0, 0, [9.0, 1.0]), (0, 1, [5.0, 5.0, 1.0]), (1, 0, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "s int, pos int, logits array<double>")
    assert {r["s"]: r["choice"] for r in next_choice(df, ["s"]).collect()} == {0: 0, 1: 1}
    assert [r[0] for r in df.orderBy("s", "pos").select(argmax(F.col("logits"))).collect()] == [0, 0, 1]
    for r in df.select("logits", softmax(F.col("logits")).alias("p")).collect():
        z = np.exp(np.array(r["logits"]) - max(r["logits"]))
        assert r["p"] == pytest.approx((z / z.sum()).tolist())
    tails = df.select(keep_last(F.col("logits"), 2).alias("t"), "logits").collect()
    assert all(r["t"] == r["logits"][-2:] for r in tails)


@pytest.mark.parametrize("target", [-1, 3, 7])
def test_a_target_without_a_logit_is_an_error(spark, target):
    positions = spark.createDataFrame([(0, [1.0, 2.0, 3.0], target)], "batch_id long, logits array<double>, target int")
    with pytest.raises(Exception, match="no logit"):
        batch_losses(positions).collect()


def test_a_model_sees_few_rows_at_a_time(spark):
    rows = [(i // 4, [1, 2], [1, -100]) for i in range(40)]
    collated = spark.createDataFrame(rows, "batch_id long, inputs array<int>, targets array<int>").coalesce(1)

    def build():
        def score(inputs):
            assert len(inputs) <= 3
            return [np.zeros((len(x), 4)) for x in inputs]

        return score

    got = model_batch_losses(collated, build, rows_per_call=3).collect()
    assert len(got) == 10 and all(abs(r["batch_loss"] - np.log(4)) < 1e-9 for r in got)


def test_a_model_without_the_target_is_an_error(spark):
    collated = spark.createDataFrame([(0, [1], [9])], "batch_id long, inputs array<int>, targets array<int>")
    build = lambda: lambda inputs: [np.zeros((len(x), 4)) for x in inputs]
    with pytest.raises(Exception, match="targets are from 0"):
        model_batch_losses(collated, build).collect()

import math
import random
import tracemalloc

import numpy as np
import pytest

from checks.queries import BYTES_AND_PAD, _formula_logits
from pairwright.operators.loss import _mass, _row_loss, _sliced_loss, batch_losses, sharded_batch_losses, sharded_position_losses, sliced_model_batch_losses

SCHEMA = "batch_id long, pos long, start int, logits array<float>, target int"


def cut(values, rng):
    starts = sorted({0, *(rng.randrange(len(values)) for _ in range(rng.randint(0, 4)))})
    return [(a, values[a:b]) for a, b in zip(starts, [*starts[1:], len(values)])]


@pytest.mark.parametrize("seed", range(3))
def test_any_slicing_gives_the_loss_of_whole_rows(spark, seed):
    rng = random.Random(seed)
    whole, shards = [], []
    for pos in range(40):
        scale = rng.choice([1, 100, 1000])
        values = [float(np.float32(rng.uniform(-scale, scale))) for _ in range(rng.randint(1, 9))]
        target = rng.choice([-100, rng.randrange(len(values))])
        whole.append((pos % 7, pos, values, target))
        parts = cut(values, rng)
        rng.shuffle(parts)
        shards += [(pos % 7, pos, a, part, target) for a, part in parts]
    want = batch_losses(spark.createDataFrame(whole, "batch_id long, pos long, logits array<float>, target int"))
    got = sharded_batch_losses(spark.createDataFrame(shards, SCHEMA).repartition(3), ["pos"])
    a, b = (sorted(map(tuple, df.collect())) for df in (want, got))
    assert [k for k, _ in a] == [k for k, _ in b]
    for (_, x), (_, y) in zip(a, b):
        assert (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y, rel=1e-9, abs=1e-9)


def one(spark, rows):
    return sharded_position_losses(spark.createDataFrame(rows, SCHEMA), ["batch_id", "pos"]).collect()


def test_special_logits(spark):
    low = float("-inf")
    rows = one(spark, [(0, 0, 0, [low, low], 2), (0, 0, 2, [5.0], 2), (0, 1, 0, [1.0], -100), (0, 1, 1, [], -100)])
    found = {r["pos"]: r["nll"] for r in rows}
    assert found[0] == pytest.approx(0.0) and found[1] is None
    assert one(spark, []) == []


@pytest.mark.parametrize(
    "rows,message",
    [
        ([(0, 0, 0, [1.0, 2.0], 1), (0, 0, 1, [3.0], 1)], "overlap or leave a gap"),
        ([(0, 0, 0, [1.0], 1), (0, 0, 2, [3.0], 1)], "overlap or leave a gap"),
        ([(0, 0, 1, [1.0], 1)], "overlap or leave a gap"),
        ([(0, 0, 0, [1.0], 0), (0, 0, 1, [1.0], 1)], "different targets"),
        ([(0, 0, 0, [1.0], 5)], "no logit for target 5"),
        ([(0, 0, 0, [1.0], -3)], "no logit for target -3"),
    ],
)
def test_wrong_slices_are_errors(spark, rows, message):
    with pytest.raises(Exception, match=message):
        one(spark, rows)


def test_only_numbers_are_shuffled(spark, plan_of):
    shards = spark.createDataFrame([(0, 0, 0, [1.0], 0)], SCHEMA)
    plan = plan_of(sharded_batch_losses(shards, ["pos"]))
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert len(exchanges) == 2 and "logits" not in below.split("Project")[0]


def test_a_model_in_slices(spark):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(50, 37)) * 30
    rows = [(i // 3, rng.integers(0, 50, 6).tolist(), [*rng.integers(0, 37, 5).tolist(), -100]) for i in range(10)]
    rows.append((9, [1], [-100]))
    df = spark.createDataFrame(rows, "batch_id long, inputs array<int>, targets array<int>")

    def build():
        return lambda ids, a, b: [table[np.asarray(i)][:, a:b] for i in ids]

    want = {}
    for batch, ids, targets in rows:
        for i, t in zip(ids, targets):
            if t != -100:
                want.setdefault(batch, []).append(np.log(np.exp(table[i] - table[i].max()).sum()) + table[i].max() - table[i, t])
    for size in (1, 5, 37, 100):
        got = {r["batch_id"]: r["batch_loss"] for r in sliced_model_batch_losses(df, build, 37, size).collect()}
        assert math.isnan(got.pop(9))
        assert got == pytest.approx({k: float(np.mean(v)) for k, v in want.items()})
    with pytest.raises(Exception, match="targets are from 0 to 36"):
        bad = spark.createDataFrame([(0, [1], [37])], df.schema)
        sliced_model_batch_losses(bad, build, 37, 10).collect()


def test_the_formula_is_that_of_all_ids():
    ids, places = np.arange(BYTES_AND_PAD), np.arange(BYTES_AND_PAD)
    assert np.array_equal(_formula_logits().take(ids % 11, axis=0), (ids[:, None] * 31 + places * 7) % 11 / 4)


@pytest.mark.parametrize("counts", [[1, 1, 1, 0], [1, 0, 1, 0], [0, 1, 1, 1], [0, 0, 0, 0], [1, 1, 1, 1]])
def test_logits_of_a_model_are_left_as_they_are(counts):
    logits = np.random.default_rng(2).normal(size=(4, 9))
    target = np.where(np.array(counts) > 0, [3, 0, 8, 5], -100)
    held = logits.copy()
    whole = _row_loss(logits, target, -100)
    sliced = _sliced_loss(((a, logits[:, a : a + 4]) for a in (0, 4, 8)), target, -100)
    want = sum(np.log(np.exp(row).sum()) - row[t] for row, t in zip(held, target) if t != -100)
    assert whole == sliced == (pytest.approx(want), sum(counts)) and np.array_equal(logits, held)


def test_exponentials_take_one_matrix_of_memory():
    rows = np.zeros((1000, 500))
    tracemalloc.start()
    _mass(rows, np.zeros(1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * rows.nbytes

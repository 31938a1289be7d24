import random
from collections import Counter

import numpy as np
import pytest

from pairwright.config import Settings
from pairwright.operators import generate
from pairwright.operators.generate import extend, extend_by_states, greedy_decode, next_token_table, table_scorer

STOP = 50256


def by_loop(ids, choose, window, steps):
    for _ in range(steps):
        seen = ids[-window:]
        pick = choose(seen)
        if pick is None or pick == STOP:
            break
        ids = seen + [pick]
    return ids


def prompts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, encoded_text array<int>")


def column(df):
    return [r["generated"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("window", [1, 8, 40])
def test_table_scorer_matches_the_loop(spark, window):
    rng = random.Random(6)
    follow = {i: rng.randrange(40) for i in range(30)} | {7: STOP}
    rows = [[rng.randrange(40) for _ in range(rng.randrange(1, 20))] for _ in range(120)] + [[], [7], [39] * 12]
    successors = spark.createDataFrame(list(follow.items()), "prev int, next int")
    settings = Settings(context_length=window, max_new_tokens=9)
    got = column(greedy_decode(prompts(spark, rows), table_scorer(successors), settings=settings))
    choose = lambda seen: follow.get(seen[-1]) if seen else None
    assert got == [by_loop(r, choose, window, 9) for r in rows]


def test_stop_rules(spark):
    long = list(range(100, 112))
    settings = Settings(context_length=8)
    table = spark.createDataFrame([(111, 5)], "prev int, next int")
    none = spark.createDataFrame([(1, 2)], "prev int, next int")
    assert column(greedy_decode(prompts(spark, [long]), table_scorer(none), settings=settings)) == [long]
    assert column(greedy_decode(prompts(spark, [long]), table_scorer(table), settings=settings)) == [long[-8:] + [5]]


def test_logits_scorer(spark):
    def build():
        def score(windows):
            logits = np.zeros((len(windows), 50257))
            seen = (windows >= 0).sum(axis=1)
            logits[np.arange(len(windows)), np.where(seen > 5, STOP, seen)] = 1.0
            return logits

        return score

    got = column(greedy_decode(prompts(spark, [[9], [9, 9, 9], [9] * 7]), build))
    assert got == [[9, 1, 2, 3, 4, 5], [9, 9, 9, 3, 4, 5], [9] * 7]


def test_next_token_counts(spark):
    rng = random.Random(8)
    rows = [[rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(60)]
    counts = Counter(p for r in rows for p in zip(r, r[1:]))
    expected = {}
    for (prev, nxt), n in sorted(counts.items(), key=lambda c: (-c[1], c[0][1])):
        expected.setdefault(prev, nxt)
    got = {r["prev"]: r["next"] for r in next_token_table(prompts(spark, rows)).collect()}
    assert got == expected


def counting():
    """A class that workers get by value."""

    class Counting:
        """Scores by a sum over all ids read so far; counts the ids it is handed."""

        def __init__(self):
            self.read = self.steps = 0
            self.most = 0

        def pick(self, states):
            return np.array([-1 if s % 11 == 3 else s * 7 % 23 for s in states])

        def start(self, prompts):
            states = [int(np.sum(p)) for p in prompts]
            self.most = len(states)
            return self.pick(states), states

        def step(self, tokens, states):
            assert len(tokens) == len(states) <= self.most
            self.most = len(states)
            self.steps += 1
            self.read += len(tokens)
            states = [s + int(t) for s, t in zip(states, tokens)]
            return self.pick(states), states

    return Counting


def test_states_are_handed_one_id_a_step_and_prompt():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 5, 9, 3, 12, 7]
    values = rng.integers(0, 20, sum(sizes)).astype(np.int32)
    offsets = np.append(0, np.cumsum(sizes))
    by_state = counting()()
    got = extend_by_states(values, offsets, by_state, 100, 15, 22)
    plain = counting()()
    whole = lambda windows: plain.pick([int(w[w >= 0].sum()) for w in windows])
    want = extend(values, offsets, whole, 100, 15, 22)
    assert [g.tolist() for g in got] == [w.tolist() for w in want]
    added = sum(len(g) - n for g, n in zip(got, sizes))
    last = sum(len(g) - n == 15 for g, n in zip(got, sizes))
    assert by_state.read == added - last and by_state.steps <= 14


def test_a_scorer_with_states_on_spark(spark):
    rows = [(i, [int(x) for x in range(i % 6)]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, encoded_text array<int>")
    settings = Settings(context_length=50, max_new_tokens=9, pad_id=22, rows_per_call=7)
    pick = counting()().pick
    windowed = lambda: lambda windows: pick([int(w[w >= 0].sum()) for w in windows])
    want = greedy_decode(df, windowed, settings=settings)
    got = greedy_decode(df, counting(), settings=settings)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_task_holds_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(generate, "ROWS_AT_ONCE", 3)

    def build():
        def score(windows):
            assert len(windows) <= 3
            return windows[:, -1] + 1

        return score

    rows = [(i, None if i % 5 == 4 else [i]) for i in range(20)]
    prompts = spark.createDataFrame(rows, "id long, encoded_text array<int>").coalesce(1)
    settings = Settings(context_length=8, max_new_tokens=2)
    got = {r["id"]: r["generated"] for r in generate.greedy_decode(prompts, build, settings=settings).collect()}
    assert got == {i: None if ids is None else [i, i + 1, i + 2] for i, ids in rows}

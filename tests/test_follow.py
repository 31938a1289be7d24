import random

import pytest

from pairwright.config import Settings
from pairwright.operators.follow import follow_table, walks
from pairwright.operators.generate import greedy_decode, table_scorer

SETTINGS = Settings(context_length=8, max_new_tokens=13, pad_id=99)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_the_same_as_a_scorer_of_the_table(spark, seed, broadcast_bytes):
    rng = random.Random(seed)
    table = {t: rng.choice([99, -1, *range(40), 3, 3, 3]) for t in range(35)}
    successors = spark.createDataFrame(list(table.items()), "prev int, next int")
    prompts = [([rng.randrange(40) for _ in range(rng.choice([0, 1, 5, 8, 9, 30]))], i) for i in range(120)]
    prompts += [(None, 1000), ([99], 1001), ([3] * 4, 1002)] + [([1, 2, 3], 2000 + i) for i in range(60)]
    df = spark.createDataFrame([(i, p, 0, []) for p, i in prompts], "id long, encoded_text array<int>, prev int, walk array<int>").repartition(5)
    want = greedy_decode(df, table_scorer(successors), settings=SETTINGS)
    got = follow_table(df, successors, settings=SETTINGS, broadcast_bytes=broadcast_bytes)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_walks_end_by_themselves(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 99), (31, 31)], "prev int, next int")
    found = {r["prev"]: r["walk"] for r in walks(chain, 13, 99).collect()}
    assert found[0] == list(range(1, 14)) and found[15] == [16, 17, 18, 19, 20] and 30 not in found and found[31] == [31] * 13
    assert walks(chain.limit(0), 13, 99).collect() == []
    short = spark.createDataFrame([(1, 2), (2, 3)], "prev int, next int")
    assert {r["prev"]: r["walk"] for r in walks(short, 1000, 99).collect()} == {1: [2, 3], 2: [3]}


def test_a_repeated_token_is_an_error(spark):
    with pytest.raises(Exception, match="repeats the token 1"):
        walks(spark.createDataFrame([(1, 2), (1, 3)], "prev int, next int"), 5, 99)

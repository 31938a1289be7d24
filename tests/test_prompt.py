import pytest
from pyspark.sql import functions as F

from pairwright.functions.prompt import render_prompt

HEAD = "Question → SPARQL:"


def rendered(spark, mode, **options):
    df = spark.createDataFrame(
        [(0, "why?", "ASK"), (1, "", "ASK"), (2, None, None), (3, " ", "")], "i int, q string, s string"
    )
    out = df.select("i", render_prompt(mode, F.col("q"), F.col("s"), **options).alias("t"))
    return [r["t"] for r in out.orderBy("i").collect()]


def test_train_and_test_prompts(spark):
    assert rendered(spark, "train") == [
        f"{HEAD}\nQuestion: why?\nSPARQL: ASK", f"{HEAD}\nSPARQL: ASK", HEAD, f"{HEAD}\nQuestion:  "
    ]
    assert rendered(spark, "test") == [f"{HEAD}\nQuestion: why?", HEAD, HEAD, f"{HEAD}\nQuestion:  "]


def test_missing_fields_may_be_shown(spark):
    assert rendered(spark, "train", null_text="nan")[2] == f"{HEAD}\nQuestion: nan\nSPARQL: nan"


def test_unknown_mode_is_an_error(spark):
    with pytest.raises(NotImplementedError):
        render_prompt("valid", F.col("q"), F.col("s"))

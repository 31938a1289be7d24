"""Samples are drawn by row, bounded, and never empty where rows are labelled."""

import pytest
from pyspark.sql import functions as F

from pairwright.llm import language, mil
from pairwright.llm.sampling import labelled_sample

SCHEMA = "doc_id long, text string, lang string"


def rows(spark, n, **same):
    made = spark.range(n, numPartitions=4).select(F.col("id").alias("i"))
    exprs = {
        "doc_id": F.lit(same["doc_id"]).cast("long") if "doc_id" in same else F.col("i"),
        "text": F.lit(same["text"]) if "text" in same else F.concat(F.lit("text number "), "i"),
        "lang": F.lit(same["lang"]).cast("string") if "lang" in same else F.when(F.col("i") % 2 == 0, "en").otherwise("de"),
    }
    return made.select(*(e.alias(c) for c, e in exprs.items()))


@pytest.mark.parametrize("same", [{}, {"doc_id": None}, {"doc_id": 7}, {"text": "one text"}, {"doc_id": 7, "text": "one text"}])
@pytest.mark.parametrize("most", [100, 4000])
def test_about_as_many_as_asked(spark, same, most):
    found = labelled_sample(rows(spark, 5000, **same), ["doc_id", "text"], "lang", most).count()
    assert 0 < found <= 2 * most
    if "text" not in same:
        assert 0.6 * most <= found


def test_no_labels(spark):
    assert labelled_sample(rows(spark, 50, lang=None), ["doc_id"], "lang", 10).count() == 0


@pytest.mark.parametrize("same", [{"doc_id": None}, {"doc_id": 3}])
def test_languages_are_learnt_where_ids_tell_nothing(spark, same):
    words = F.when(F.col("lang") == "en", "the of and with from").otherwise("der und nicht auch sich")
    docs = rows(spark, 6000, **same).withColumn("text", F.concat_ws(" ", words, "text"))
    model = language.fit_language(docs)
    got = language.identify(docs, model).select("lang", "language.pred").groupBy("lang", "pred").count().collect()
    assert {(r["lang"], r["pred"]) for r in got} == {("en", "en"), ("de", "de")}


def test_one_id_on_all_rows_is_bounded(spark, monkeypatch):
    docs = rows(spark, 900, doc_id=1)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    sizes = []
    real = mil.fit
    monkeypatch.setattr(mil, "fit", lambda bags, y, s: sizes.append(len(bags)) or real(bags, y, s))
    mil.fit_quality(docs, labels, settings=mil.MilSettings(sample_rows=50))
    assert sizes == [50]

"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import canonical, oracle_rows
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    theirs = oracle_rows(SF_DIR, ORACLE[name])
    assert set(ours.columns) == set(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_generation_meets_the_stop(spark):
    """The table of followers holds the end, and some turns end before all steps are made."""
    grown = QUERIES["q_greedy_stop"](spark, SF_DIR).toPandas()
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "text").toPandas()
    both = grown.merge(turns, on=["conv_id", "turn"])
    made = [len(g.split()) - min(len(t.encode()), 96) for g, t in zip(both["generated"], both["text"])]
    assert min(made) < 50 and not any("50256" in g for g in both["generated"])

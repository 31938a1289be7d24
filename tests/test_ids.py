"""Ids and labels in text, against a walk over the text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pairwright.functions.ids import extract_eids, extract_labels
from pairwright.operators.dictionary import build_dictionary
from pairwright.operators.rewrite import decode_labels, encode_ids, encode_ids_inline

EID = re.compile(r"[a-zA-Z]+:[a-zA-Z]+\d+")


def encode_by_walk(text, table):
    """Walk over the text once; an id counts where no letter, digit or underscore touches it."""
    inside = lambda c: c == "_" or c.isalnum()
    out, at = [], 0
    for match in EID.finditer(text):
        start, stop = match.span()
        whole = (start == 0 or not inside(text[start - 1])) and (stop == len(text) or not inside(text[stop]))
        if whole and match[0] in table:
            out += [text[at:start], table[match[0]]]
            at = stop
    return "".join(out) + text[at:]


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "row_id long, sparql string")


def column(df, name):
    return [r[name] for r in df.orderBy("row_id").collect()]


ADVERSARIAL = [
    "ab1wd:Q12 wd:Q12abc wd:Q12",
    "x:y:Q12 a:b1c:d2 _wd:Q12 wd:Q12_",
    "éwd:Q12 wd:Q12é (wd:Q12)",
    "wd:Q١٢ wd:Q1",
    "xsd:int32 p1:Q1 wd:Q12",
    "²wd:Q12 wd:Q12² ½wd:Q1",
    "",
    "no ids at all",
    "a" * 5000 + " wd:Q7 " + "b:" * 500,
]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_encode_matches_a_walk(spark, broadcast_bytes):
    rng = random.Random(5)
    pieces = ["wd:Q12", "wd:Q1", "p:P3", "x:", ":", "_", " ", "é", "1", "abc", "٣", "wd", "Q", "²", "\n"]
    rows = ADVERSARIAL + ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(400)] + [None]
    found = {e for t in rows if t for e in EID.findall(t)}
    known = {e: f"ENTITY_{i:04d}" for i, e in enumerate(sorted(found)) if i % 5}
    dictionary = spark.createDataFrame(list(known.items()), "eid string, label string")
    got = column(encode_ids(texts(spark, rows), dictionary, broadcast_bytes=broadcast_bytes), "sparql_modf")
    assert got == [None if t is None else encode_by_walk(t, known) for t in rows]


def test_extraction_matches_findall(spark):
    df = texts(spark, ADVERSARIAL).withColumn("ids", extract_eids(F.col("sparql")))
    assert column(df, "ids") == [EID.findall(t) for t in ADVERSARIAL]
    rows = ["ENTITY_1 xENTITY_2 ENTITY_3x ENTITY_٤ _ENTITY_5", "ENTITY_ ENTITY_UNK", "éENTITY_1 ENTITY_22."]
    df = texts(spark, rows).withColumn("labels", extract_labels(F.col("sparql")))
    assert column(df, "labels") == [re.findall(r"\bENTITY_\d+\b", t) for t in rows]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_decode_replaces_substrings_in_order(spark, broadcast_bytes):
    known = {"ENTITY_01": "wd:Q5", "ENTITY_00": "ENTITY_UNK", "ENTITY_012": "p:P9"}
    rows = [
        "ENTITY_01 ENTITY_013 XENTITY_01 ENTITY_00",
        "ENTITY_012 ENTITY_01 ENTITY_012",
        "ENTITY_01 ENTITY_012 ENTITY_77",
        "none",
        None,
    ]
    dictionary = spark.createDataFrame([(e, l) for l, e in known.items()], "eid string, label string")
    df = texts(spark, rows)
    got = column(decode_labels(df, dictionary, text="sparql", broadcast_bytes=broadcast_bytes), "decoded_sparql")
    assert got == [
        "wd:Q5 wd:Q53 Xwd:Q5 ENTITY_UNK",
        "p:P9 wd:Q5 p:P9",
        "wd:Q5 wd:Q52 ENTITY_77",
        "none",
        None,
    ]
    bounded = column(decode_labels(df, dictionary, text="sparql", bounded=True), "decoded_sparql")
    assert bounded[0] == "wd:Q5 ENTITY_013 XENTITY_01 ENTITY_UNK"


def test_dictionary_is_a_bijection_of_equal_widths(spark):
    rows = ["wd:Q2 wd:Q10 p:P1", "wd:Q2 ab1wd:Q3abc", None, *[f"z:K{i}" for i in range(120)]]
    df = texts(spark, rows).withColumnRenamed("sparql", "sparql_wikidata")
    got = {r["eid"]: r["label"] for r in build_dictionary(df).collect()}
    ids = sorted({e for t in rows if t for e in EID.findall(t)}, key=str.encode)
    assert got == {"ENTITY_UNK": "ENTITY_000", **{e: f"ENTITY_{i:03d}" for i, e in enumerate(ids, 1)}}
    assert len(set(got.values())) == len(ids) + 1


def test_empty_corpus_has_the_unknown_row_only(spark):
    df = texts(spark, ["nothing", None]).withColumnRenamed("sparql", "sparql_wikidata")
    rows = build_dictionary(df).collect()
    assert [(r["eid"], r["label"]) for r in rows] == [("ENTITY_UNK", "ENTITY_0")]


def test_round_trip(spark):
    rows = [f"SELECT {{ wd:Q{i} p:P{i % 7} ?x }}" for i in range(50)]
    df = texts(spark, rows)
    dictionary = build_dictionary(df.withColumnRenamed("sparql", "sparql_wikidata"))
    back = decode_labels(encode_ids_inline(df, dictionary), dictionary)
    assert column(back, "decoded_sparql") == rows

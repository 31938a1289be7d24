import pytest
from pyspark.sql import functions as F

from pairwright.operators.grown_dictionary import grow_dictionary, grow_from_stream, read_grown, versions_of
from pairwright.operators.rewrite import decode_labels, encode_ids

PREFIX = "ENTITY_"


def queries(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "sparql_wikidata string")


def by_label(df):
    return {r["eid"]: (r["label"], r["version"]) for r in df.collect()}


def test_labels_given_never_change(spark, tmp_path):
    path = str(tmp_path / "d")
    one = by_label(grow_dictionary(spark, path, queries(spark, "ex:K5 ex:K10 ex:K5", None, "no ids"), 0, width=4))
    assert one == {"ENTITY_UNK": (PREFIX + "0000", 0), "ex:K10": (PREFIX + "0001", 0), "ex:K5": (PREFIX + "0002", 0)}
    two = by_label(grow_dictionary(spark, path, queries(spark, "ex:K5 ex:B7 ex:A9"), 3, width=4))
    assert {k: two[k] for k in one} == one
    assert two["ex:A9"] == (PREFIX + "0003", 3) and two["ex:B7"] == (PREFIX + "0004", 3) and len(two) == 5
    assert by_label(grow_dictionary(spark, path, queries(spark, "ex:Z1 ex:Z2"), 3, width=4)) == two  # a repeated batch
    assert by_label(grow_dictionary(spark, path, queries(spark, "nothing"), 4, width=4)) == two
    assert versions_of(spark, path) == [0, 3, 4] and by_label(read_grown(spark, path, 0)) == one
    with pytest.raises(ValueError, match="already there"):
        grow_dictionary(spark, path, queries(spark, "ex:Q1"), 2, width=4)
    with pytest.raises(ValueError, match="4 digits wide"):
        grow_dictionary(spark, path, queries(spark, "ex:Q1"), 5, width=6)


def test_what_a_failed_run_leaves_is_overwritten(spark, tmp_path):
    path = tmp_path / "d"
    grow_dictionary(spark, str(path), queries(spark, "ex:K1"), 0)
    part = path / "version=1"
    part.mkdir()
    (part / "part-0.parquet").write_bytes(b"half a file")
    assert versions_of(spark, str(path)) == [0]
    grown = by_label(grow_dictionary(spark, str(path), queries(spark, "ex:K2"), 1))
    assert grown["ex:K2"] == (PREFIX + "000000000002", 1)


def test_a_number_without_room_is_an_error(spark, tmp_path):
    path = str(tmp_path / "d")
    grow_dictionary(spark, path, queries(spark, *(f"ex:K{i}" for i in range(8))), 0, width=1)
    with pytest.raises(Exception, match="have no room for 10"):
        grow_dictionary(spark, path, queries(spark, "ex:L1 ex:L2 ex:L3"), 1, width=1)
    assert versions_of(spark, path) == [0]
    assert len(by_label(grow_dictionary(spark, path, queries(spark, "ex:L1"), 1, width=1))) == 10


def test_batches_of_a_stream_are_versions(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "d")
    queries(spark, "ex:K1 ex:K2").write.parquet(str(source))
    stream = lambda: spark.readStream.schema("sparql_wikidata string").parquet(str(source))
    grow_from_stream(stream(), path, str(tmp_path / "c"), width=3, availableNow=True).awaitTermination()
    first = by_label(read_grown(spark, path))
    queries(spark, "ex:K2 ex:A1").write.mode("append").parquet(str(source))
    grow_from_stream(stream(), path, str(tmp_path / "c"), width=3, availableNow=True).awaitTermination()
    both = by_label(read_grown(spark, path))
    assert both == first | {"ex:A1": (PREFIX + "003", 1)} and versions_of(spark, path) == [0, 1]
    # The stream forgets what it did, and gives the same batch ids again.
    grow_from_stream(stream(), path, str(tmp_path / "other"), width=3, availableNow=True).awaitTermination()
    assert by_label(read_grown(spark, path)) == both


def test_rewriting_with_a_grown_dictionary(spark, tmp_path):
    path = str(tmp_path / "d")
    grow_dictionary(spark, path, queries(spark, "ex:K1 ex:K2"), 0)
    grown = grow_dictionary(spark, path, queries(spark, "ex:K3"), 1).drop("version", "number")
    rows = spark.createDataFrame([(0, "ASK { ex:K3 ex:K1 ex:K9 }")], "row_id long, sparql string")
    coded = encode_ids(rows, grown)
    assert PREFIX + "000000000003" in coded.first()["sparql_modf"]
    assert decode_labels(coded, grown).first()["decoded_sparql"] == "ASK { ex:K3 ex:K1 ex:K9 }"


def test_an_empty_first_batch(spark, tmp_path):
    made = grow_dictionary(spark, str(tmp_path / "d"), queries(spark), 0)
    assert by_label(made) == {"ENTITY_UNK": (PREFIX + "0" * 12, 0)}
    assert by_label(read_grown(spark, str(tmp_path / "none"))) == {}
    assert made.select(F.max("number")).first()[0] == 0

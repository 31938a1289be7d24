import pytest
from pyspark.sql import functions as F

from pairwright.config import Settings
from pairwright.operators.batches import collate, collate_stored, load_batches
from pairwright.sources.batch_table import is_batch_table, laid_out, read_record, read_token_batches, write_token_batches

SETTINGS = Settings(batch_sizes={"train": 8, "val": 3}, pad_id=9, max_length=11)


@pytest.fixture(scope="module")
def tokens(spark):
    sizes = {"train": 1003, "val": 50}
    rows = [(s, i, [i % 7] * (i * 37 % 13), [f"t{i % 7}"] * (i * 37 % 13)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "split string, ord long, encoded_text array<int>, decoded_text array<string>").repartition(5)


@pytest.fixture(scope="module")
def path(tokens, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tokens") / "t")
    write_token_batches(tokens, where, SETTINGS, batches_per_file=10)
    return where


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("split", ["train", "val"])
def test_collating_the_table_needs_no_exchange(spark, tokens, path, plan_of, split):
    stored = collate_stored(read_token_batches(spark, path, split), SETTINGS, texts=True)
    made = collate(load_batches(tokens, split, SETTINGS), SETTINGS, texts=True)
    columns = ["ord", "batch_id", "inputs", "targets", "inputs_txt", "targets_txt"]
    assert rows(stored.select(*columns)) == rows(made.select(*columns))
    plan = plan_of(stored)
    assert "Exchange" not in plan and "Window" not in plan


def scanned(df):
    """(files read, rows that left the scan)."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    metrics = node.metrics()
    return tuple(metrics.apply(name).value() for name in ("numFiles", "numOutputRows"))


def test_one_record_reads_one_file(spark, path):
    found = read_record(spark, path, "train", 777)
    assert [r["ord"] for r in found.collect()] == [777]
    files, read = scanned(read_token_batches(spark, path, "train", 97, 97))
    assert files == 1 and read <= 80
    assert read_record(spark, path, "val", 50).collect() == []


def test_batches_asked_for(spark, path):
    got = read_token_batches(spark, path, "train", 9, 11)
    assert sorted(r["ord"] for r in got.collect()) == list(range(72, 96))
    assert scanned(read_token_batches(spark, path, "train", 9, 11))[0] == 2
    last = read_token_batches(spark, path, "val", first=16).collect()
    assert sorted(r["ord"] for r in last) == [48, 49]
    assert read_token_batches(spark, path).count() == 1053 and is_batch_table(spark, path)


def test_files_hold_whole_batches_in_order(spark, path):
    held = read_token_batches(spark, path).withColumn("file", F.input_file_name())
    assert held.groupBy("split", "batch_id").agg(F.countDistinct("file").alias("n")).where("n > 1").isEmpty()
    placed = held.select("file", "ord", F.monotonically_increasing_id().alias("at")).collect()
    by_file = {}
    for r in sorted(placed, key=lambda r: r["at"]):
        by_file.setdefault(r["file"], []).append(r["ord"])
    assert len(by_file) == 15 and all(v == sorted(v) for v in by_file.values())


def test_one_exchange_to_write(tokens, spark, tmp_path, plan_of):
    tokens.write.parquet(str(tmp_path / "t"))
    plan = plan_of(laid_out(spark.read.parquet(str(tmp_path / "t")), SETTINGS, 10))
    assert plan.count("Exchange") == 1 and "Window" in plan


def test_an_unknown_split_and_an_empty_table(spark, tokens, tmp_path):
    with pytest.raises(Exception, match="no batch size for split other"):
        write_token_batches(tokens.limit(1).withColumn("split", F.lit("other")), str(tmp_path / "bad"), SETTINGS)
    assert not is_batch_table(spark, str(tmp_path / "bad"))
    write_token_batches(tokens.limit(0), str(tmp_path / "none"), SETTINGS)
    assert read_token_batches(spark, str(tmp_path / "none"), "train").collect() == []
    with pytest.raises(NotImplementedError):
        read_token_batches(spark, str(tmp_path / "none"), "other")

import glob
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.sources.batch_sink import BatchWriter, manifests, read_batches, write_batches

SCHEMA = "batch_id long, inputs array<array<int>>, name string"


def rows(spark, ids):
    return spark.createDataFrame([(i, [[i, 1], []] if i % 3 else None, f"n{i}") for i in ids], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_come_back(spark, tmp_path):
    path = str(tmp_path / "b")
    write_batches(rows(spark, range(20)).repartition(3), path)
    write_batches(rows(spark, range(20, 25)), path)
    both = read_batches(spark, path, SCHEMA)
    assert found(both) == found(rows(spark, range(25))) and len(manifests(path)) == 2
    assert [r["batch_id"] for r in read_batches(spark, path, SCHEMA, first=19, last=20).orderBy("batch_id").collect()] == [19, 20]
    assert read_batches(spark, path, SCHEMA, first=21).rdd.getNumPartitions() < both.rdd.getNumPartitions()
    assert both.select("name").where("batch_id = 7").first()["name"] == "n7"


def test_a_second_attempt_leaves_no_second_copy(spark, tmp_path):
    """The first attempt of a task writes all of its rows and is then lost before it reports."""
    path = str(tmp_path / "b")
    writer = BatchWriter(path, "batch_id")
    batch = pa.RecordBatch.from_pylist([{"batch_id": i, "name": f"n{i}"} for i in range(4)])
    writer.write(iter([batch]))
    halfway = iter([batch, None])
    with pytest.raises(AttributeError):
        writer.write(halfway)
    kept = writer.write(iter([batch]))
    writer.commit([kept, None, writer.write(iter([]))])
    assert len(glob.glob(path + "/part-*")) == 3
    got = read_batches(spark, path, "batch_id long, name string")
    assert found(got) == [(i, f"n{i}") for i in range(4)]


def test_a_failing_task_leaves_nothing_that_is_read(spark, tmp_path):
    path = str(tmp_path / "b")
    write_batches(rows(spark, range(3)), path)
    bad = rows(spark, range(3, 40)).repartition(4).withColumn("name", F.when(F.col("batch_id") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        write_batches(bad, path)
    assert found(read_batches(spark, path, SCHEMA)) == found(rows(spark, range(3)))
    assert len(manifests(path)) == 1
    write_batches(rows(spark, range(3, 40)).repartition(4), path)
    assert found(read_batches(spark, path, SCHEMA)) == found(rows(spark, range(40)))


def test_nothing_written_and_no_overwriting(spark, tmp_path):
    path = str(tmp_path / "b")
    assert read_batches(spark, str(tmp_path / "none"), SCHEMA).collect() == []
    write_batches(rows(spark, []), path)
    assert read_batches(spark, path, SCHEMA).collect() == [] and [m["rows"] for m in manifests(path)] == [0]
    with pytest.raises(Exception, match="another path"):
        rows(spark, [1]).write.format("pairwright_batches").options(path=path).mode("overwrite").save()
    assert Path(path).is_dir()

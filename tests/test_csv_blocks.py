"""CSV read by blocks against Python's csv module and the engine's one-task reader."""

import csv
import io
import random

import pytest

from pairwright.sources.csv_blocks import _states, read_csv_blocks
from pairwright.sources.pairs import read_raw_pairs

SCHEMA = "id long, t string, u string"
PIECES = ["a", "b ", '"', '""', ",", "\n", "\r\n", "\n\n", "é→", "x" * 40, "'", '",\n"', " ", "\x85"]


@pytest.fixture
def small_blocks(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def field(rng):
    return "".join(rng.choices(PIECES, k=rng.choice([0, 1, 3, 8, 30])))


def write(path, rows, ends="\n", quoting=csv.QUOTE_MINIMAL):
    held = io.StringIO()
    out = csv.writer(held, lineterminator=ends, quoting=quoting)
    out.writerows([["id", "t", "u"], *rows])
    path.write_bytes(held.getvalue().encode())
    return held.getvalue()


@pytest.mark.parametrize("seed,size,ends,quoting", [(1, 500, "\n", csv.QUOTE_MINIMAL), (2, 150, "\r\n", csv.QUOTE_ALL), (3, 900, "\r\n", csv.QUOTE_MINIMAL)])
def test_random_files_by_small_blocks(spark, small_blocks, tmp_path, seed, size, ends, quoting):
    rng = random.Random(seed)
    rows = []
    for name in ("a.csv", "b.csv", "c.csv"):
        own = [(len(rows) + i, field(rng), field(rng)) for i in range(rng.choice([0, 1, 40]) if name != "c.csv" else 40)]
        write(tmp_path / name, own, ends, quoting)
        rows += own
    small_blocks(size)
    got = read_csv_blocks(spark, str(tmp_path), SCHEMA, row_id="row")
    found = sorted(got.collect())
    assert [tuple(r) for r in found] == [(i, k, t or None, u or None) for i, (k, t, u) in enumerate(rows)]
    if ends == "\n":  # the other reader takes CRLF in fields for LF at times
        plain = spark.read.options(header=True, quote='"', escape='"', multiLine=True).schema(SCHEMA).csv(str(tmp_path))
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, got.drop("row").collect()))


def test_stray_quotes_blank_lines_and_an_open_end(spark, small_blocks, tmp_path):
    text = '\n\r\nid,t,u\n1,ab"c"d,"x"y\n\n2," ""\n\n"" ",z"\n\r\n3,"a""",\n4,"never closed,\nto the, end'
    for size in (11, 1000):
        folder = tmp_path / str(size)
        folder.mkdir()
        (folder / "x.csv").write_bytes(text.encode())
        small_blocks(size)
        got = [tuple(r) for r in read_csv_blocks(spark, str(folder), SCHEMA, "row").orderBy("row").collect()]
        assert got[:3] == [(0, 1, 'ab"c"d', '"x"y'), (1, 2, ' "\n\n" ', 'z"'), (2, 3, 'a"', None)]
        assert got[3][:2] == (3, 4) and "never closed,\nto the, end" in got[3][2]
        assert len(got) == 4


def test_a_record_of_many_blocks(spark, small_blocks, tmp_path):
    wide = 'line, with "quotes"\n' * 100
    rows = [(0, "x", "y"), (1, wide, wide), (2, "z", ""), (3, "\n" * 300, "w")]
    write(tmp_path / "x.csv", rows)
    small_blocks(400)
    got = read_csv_blocks(spark, str(tmp_path), SCHEMA, "row").orderBy("row").collect()
    assert [tuple(r) for r in got] == [(i, k, t or None, u or None) for i, (k, t, u) in enumerate(rows)]


def test_one_file_is_read_by_many_tasks(spark, small_blocks, tmp_path):
    rows = [(i, f'question, "{i}"\nof two lines', "u" * (i % 50)) for i in range(2000)]
    text = write(tmp_path / "x.csv", rows)
    small_blocks(10_000)
    got = read_csv_blocks(spark, str(tmp_path / "x.csv"), SCHEMA, "row")
    parts = spark.read.options(lineSep="\n").text(str(tmp_path / "x.csv")).rdd.getNumPartitions()
    assert parts >= len(text) // 10_000 and got.rdd.getNumPartitions() >= parts
    assert [tuple(r) for r in got.orderBy("row").collect()] == [(i, k, t, u or None) for i, (k, t, u) in enumerate(rows)]


def test_a_header_alone_and_no_rows(spark, tmp_path):
    write(tmp_path / "x.csv", [])
    assert read_csv_blocks(spark, str(tmp_path)).columns == ["id", "t", "u"]
    assert read_csv_blocks(spark, str(tmp_path), row_id="row").collect() == []


def test_compressed_files(spark, tmp_path):
    import gzip

    rows = [(i, "a\nb", '"') for i in range(50)]
    text = write(tmp_path / "x.csv", rows)
    (tmp_path / "x.csv").unlink()
    (tmp_path / "x.csv.gz").write_bytes(gzip.compress(text.encode()))
    assert sorted(tuple(r) for r in read_csv_blocks(spark, str(tmp_path), SCHEMA).collect()) == rows


def test_other_blocks_in_the_second_scan_are_an_error(spark, small_blocks, tmp_path):
    write(tmp_path / "x.csv", [(i, "a\nb", "c") for i in range(300)])
    small_blocks(1000)
    got = read_csv_blocks(spark, str(tmp_path), SCHEMA)
    small_blocks(100_000)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    with pytest.raises(Exception, match="cut otherwise"):
        got.collect()


def test_raw_pairs_of_one_column_are_parsed(spark, tmp_path, plan_of):
    (tmp_path / "x.csv").write_text('uid,paraphrased_question,other,sparql_wikidata\n1,"q\nq",z,NA\n')
    raw = read_raw_pairs(spark, str(tmp_path), pandas_missing=True)
    assert [tuple(r) for r in raw.collect()] == [(0, "q\nq", None)]


def test_states_of_lines():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        opens, closes = rng.random(30) < 0.4, rng.random(30) < 0.4
        for entry in (0, 1):
            state, want = entry, [entry]
            for o, c in zip(opens, closes):
                state = int(o) if state == 0 else int(not c)
                want.append(state)
            assert _states(opens, closes, entry).tolist() == want

"""CSV files with line breaks inside fields, read by as many tasks as files have blocks.

A block cannot tell whether it begins inside quotes. So each block first gives a map of two states
(outside or inside quotes on entry, to the state on exit, with the number of records that begin in
the block in either case). Maps of the blocks of a file are composed in order by a window over
blocks, which tells how each block really begins and how many records come before it. A second
scan then cuts the lines of every block into records, numbered over all files. The few records
that cross a block's end come in pieces from several tasks and are put together by their number.

The text itself never moves but for those pieces. Lines are read by Spark's text source, so any
file system and compression it knows will do (compressed files are one block each), and records
are parsed by the engine's own CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.workspace import materialize

QUOTING = {"quote": '"', "escape": '"', "multiLine": True}
# A field that ends on its line: quoted, with whatever follows its closing quote, or plain.
_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)'
_ENDS_OUTSIDE = rf"^{_FIELD}(?:,{_FIELD})*+\z"
_LEAVES_QUOTES = rf'^(?:[^"]++|"")*+"[^,]*+(?:,{_FIELD})*+\z'

_BLOCK = ["file", "block"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line, opens, closes, blank): whether a line that begins outside quotes ends inside them,
    whether one that begins inside ends outside, and whether it is empty."""
    read = spark.read.options(lineSep="\n").text(path)
    line, quoted = F.col("value"), F.contains(F.col("value"), F.lit('"'))
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        line.alias("line"),
        (quoted & ~line.rlike(_ENDS_OUTSIDE)).alias("opens"),
        (quoted & line.rlike(_LEAVES_QUOTES)).alias("closes"),
        line.isin("", "\r").alias("blank"),
    )


def _states(opens: np.ndarray, closes: np.ndarray, entry: int) -> np.ndarray:
    """The state (1: inside quotes) before each line and behind the last one.

    A line that ends in the same state whatever it begins in sets the state; behind the last of
    these only the lines count that swap it.
    """
    sets = opens != closes  # from outside it ends inside, and from inside it does not end outside; or neither
    swaps = np.cumsum(opens & closes)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    known = last >= 0
    begun = np.where(known, opens[last], entry)
    after = begun ^ ((swaps - np.where(known, swaps[last], 0)) & 1)
    return np.concatenate([[entry], after]).astype(np.int8)


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a block begins here, lines of one block) in the order of the scan."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("file").dictionary_encode()
        files, blocks = codes.indices.to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            block = codes.dictionary[int(files[a])].as_py(), int(blocks[a])
            yield block != before, batch.slice(a, b - a)
            before = block


_MAP = "file string, block long, n_lines long, from_out int, from_in int, starts_out long, starts_in long"


def _block_maps(lines: DataFrame) -> DataFrame:
    """A row for each block: its lines, and for both states on entry the exit and the records that begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for opened, part in _by_block(batches):
            if opened:
                held.append([part.column("file")[0].as_py(), part.column("block")[0].as_py(), 0, 0, 1, 0, 0])
            row = held[-1]
            row[2] += part.num_rows
            full = ~_flags(part, "blank")
            for k in (0, 1):
                states = _states(_flags(part, "opens"), _flags(part, "closes"), row[3 + k])
                row[5 + k] += int((full & (states[:-1] == 0)).sum())
                row[3 + k] = int(states[-1])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*held) if held else [[]] * 7, kinds)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _MAP.split(", ")])

    return lines.select(*_BLOCK, "opens", "closes", "blank").mapInArrow(run, _MAP)


def _entries(maps: DataFrame) -> DataFrame:
    """A row for each block: ``entry`` and ``exit`` state, ``first``, the number over all files of the first
    record that begins in or behind it, ``head``, that of its file's first record, which is the
    header, and ``heads``, how many files up to this one have a header."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("from_out") > F.col("from_in")).cast("long")
    known = maps.withColumn("swaps", F.coalesce(F.sum(swap).over(earlier), F.lit(0).cast("long")))
    sets = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("state"), "swaps"))
    known = known.withColumn("last", F.last(sets, ignorenulls=True).over(earlier))
    swapped = F.col("last.state") + F.col("swaps") - F.col("last.swaps")
    known = known.withColumn("entry", (F.coalesce(swapped, F.col("swaps")) % 2).cast("int"))
    inside = F.col("entry") == 1
    known = known.withColumns(
        {
            "exit": F.when(inside, F.col("from_in")).otherwise(F.col("from_out")),
            "starts": F.when(inside, F.col("starts_in")).otherwise(F.col("starts_out")),
        }
    )
    # Windows over all blocks: a row for each, small whatever the files hold.
    before = Window.orderBy(*_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("first", F.coalesce(F.sum("starts").over(before), F.lit(0).cast("long")))
    # A header begins in the first block of its file that has a beginning.
    leads = ((F.col("starts") > 0) & (F.coalesce(F.sum("starts").over(earlier), F.lit(0).cast("long")) == 0)).cast("long")
    known = known.withColumn("heads", F.sum(leads).over(Window.orderBy(*_BLOCK).rowsBetween(Window.unboundedPreceding, 0)))
    by_file = Window.partitionBy("file")
    return known.select(
        *_BLOCK, "n_lines", "entry", "exit", "first", F.min("first").over(by_file).alias("head"), F.max("heads").over(by_file).alias("heads")
    )


def _pieces(lines: DataFrame, whole: bool) -> DataFrame:
    """(row, part, text) of the records that lie in one block, or else of the pieces of the others.

    Rows are numbered without headers, which have -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []  # lines of the record that is open
        state = number = seen = part = told = head = heads = 0
        crossing = False  # whether the open record began in an earlier block

        def made(texts: pa.Array, numbers: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
            rows = np.where(numbers == head, -1, numbers - heads)
            columns = [pa.array(rows, pa.int64()), pa.array(parts, pa.int64()), texts.cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["row", "part", "text"])

        def piece(kept: bool) -> Iterator[pa.RecordBatch]:
            if waiting and kept:
                text = pc.binary_join(pa.ListArray.from_arrays([0, sum(map(len, waiting))], pa.concat_arrays(waiting)), "\n")
                yield made(text, np.array([number - 1]), np.array([part]))
            waiting.clear()

        def checked() -> None:
            if seen != told:
                raise ValueError("blocks of files were cut otherwise in a second scan; keep the session's settings")

        for opened, batch in _by_block(batches):
            if opened:
                yield from piece(not whole)  # what is open at a block's end is a piece
                checked()
                first = lambda c: batch.column(c)[0].as_py()
                state, number, part, told = first("entry"), first("first"), first("block"), first("n_lines")
                head, heads = first("head"), first("heads")
                crossing, seen = state == 1, 0
            seen += batch.num_rows
            states = _states(_flags(batch, "opens"), _flags(batch, "closes"), state)
            blank = _flags(batch, "blank") & (states[:-1] == 0)
            starts = np.flatnonzero((states[:-1] == 0) & ~blank)
            text = batch.column("line")
            if len(starts) and blank.any():
                kept = np.flatnonzero(~blank)
                text, starts = text.take(pa.array(kept)), np.searchsorted(kept, starts)
            elif blank.all():
                text = text.slice(0, 0)
            lead = int(starts[0]) if len(starts) else len(text)
            if lead:
                waiting.append(text.slice(0, lead))
            if len(starts):
                # The record that was open ends here; all but the last that begin here are whole.
                yield from piece(whole != crossing)
                crossing = False
                if whole and len(starts) > 1:
                    edges = pa.array(starts - lead, pa.int32())
                    joined = pc.binary_join(pa.ListArray.from_arrays(edges, text.slice(lead, int(starts[-1]) - lead)), "\n")
                    yield made(joined, number + np.arange(len(joined)), np.zeros(len(joined), np.int64))
                number += len(starts)
                waiting.append(text.slice(int(starts[-1])))
            state = int(states[-1])
            if state == 0:
                # The open record ends with the batch; it is a piece only if it began earlier.
                yield from piece(whole != crossing)
                crossing = False
        yield from piece(not whole)
        checked()

    return lines.mapInArrow(run, "row long, part long, text string")


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(row, text): every record of every file but the headers, with its number over all."""
    lines = _lines(spark, path)
    blocks = materialize(_entries(materialize(_block_maps(lines), "csv-maps")), "csv-blocks")
    told = [*_BLOCK, "n_lines", "entry", "first", "head", "heads"]
    records = _pieces(lines.join(F.broadcast(blocks.select(*told)), _BLOCK), whole=True).select("row", "text")
    crossing = blocks.where((F.col("entry") == 1) | (F.col("exit") == 1))
    if not crossing.isEmpty():
        pieces = _pieces(lines.join(F.broadcast(crossing.select(*told)), _BLOCK), whole=False)
        parts = F.sort_array(F.collect_list(F.struct("part", "text")))
        put = pieces.groupBy("row").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
        records = records.unionByName(put)
    return records.where(F.col("row") >= 0)


def header_of(spark: SparkSession, path: str | list[str]) -> StructType:
    """The names of the first record, all text."""
    return spark.read.options(header=True, **QUOTING).csv(path).schema


def read_csv_blocks(
    spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, row_id: str | None = None
) -> DataFrame:
    """Records of CSV files that each begin with a header, read by as many tasks as blocks.

    Fields may hold commas, doubled quotes and line breaks; a quote inside an unquoted field is
    text; empty lines between records are left out; a quote that is never closed takes the rest
    of its file. Files are UTF-8 with lines that end in LF or CRLF. Without a schema every column
    is text, under the names of the first header. ``row_id`` names a column, put first, with the
    number of the record from 0, by file name and place in the file.
    """
    schema = header_of(spark, path) if schema is None else schema
    records = _records(spark, path)
    text = F.col("text")
    text = F.when(F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in QUOTING.items()}
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = records.select("row", F.from_csv(text, kind, options).alias("_r"))
    return parsed.select(*([F.col("row").alias(row_id)] if row_id else []), "_r.*")

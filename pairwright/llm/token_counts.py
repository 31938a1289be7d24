"""Tokens of every text, counted by compiled finite-state transducers."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.bpe_machine import CountingMachine, MergeTable
from pairwright.llm.pretokens import Pieces, split_special
from pairwright.llm.texts import slices, sums

MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces and bytes of pieces that a worker keeps.
MAX_KNOWN = 600_000
MAX_KNOWN_BYTES = 32 << 20


def read_vocabulary(path: str) -> str:
    """The content of a vocabulary file, small enough to be sent to every task."""
    if Path(path).stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary file has at most {MAX_VOCABULARY_BYTES} bytes")
    return Path(path).read_text(encoding="utf-8")


class Counter:
    """Counts by text; pieces met before are remembered, as far as the bounds allow."""

    def __init__(self, content: str):
        table = MergeTable(content)
        self.special = table.specials[0] if table.specials else ""
        self.machine = CountingMachine(table)
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0

    def pieces(self, pieces: pa.Array) -> np.ndarray:
        if len(self.known) > MAX_KNOWN or self.known_bytes > MAX_KNOWN_BYTES:
            self.known.clear()
            self.known_bytes = 0
        held, known, count = pieces.dictionary_encode(), self.known, self.machine.count
        sizes = np.empty(len(held.dictionary), np.int64)
        for i, piece in enumerate(held.dictionary.to_pylist()):
            size = known.get(piece)
            if size is None:
                size = known[piece] = count(piece)
                self.known_bytes += len(piece)
            sizes[i] = size
        return sizes[held.indices.to_numpy()]

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; special strings in a text are one token each."""
        if self.special and pc.any(pc.match_substring(texts, self.special)).as_py():
            parts, first = split_special(texts.to_pylist(), self.special)
            return sums(self.plain(parts), first).astype(np.int64) + np.diff(first) - 1
        return self.plain(texts)

    def plain(self, texts: pa.Array) -> np.ndarray:
        held = Pieces(texts)
        if not len(held.words):
            return np.zeros(len(texts), np.int64)
        return sums(self.pieces(held.words), held.first).astype(np.int64)


@lru_cache(maxsize=2)
def counter(content: str) -> Counter:
    """One for each worker process, kept between its tasks."""
    made = Counter(content)
    # The states are many small objects that live on: look through them less often.
    gc.freeze()
    gc.set_threshold(100_000, 50, 50)
    return made


def count_tokens(
    docs: DataFrame, vocabulary_path: str, limit: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    Counts are those of the ``tokenizers`` library without special tokens added; a special string
    inside a text is one token, the library's default. Null and empty texts have 0 bytes and 0
    tokens. Rows are counted one by one: repeated rows and null ids give as many result rows, an
    empty table none. Only the id and the text are read, so other columns may have any name.
    Texts are cut into bounded slices at row borders and into chunks inside a slice; there is no
    shuffle, and a lost executor costs only the tasks it was running.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    held = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = counter(content.value)
        for batch in batches:
            for part in slices(batch):
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                tokens = counting.texts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), size, pa.array(tokens), pa.array(tokens > limit)],
                    [id_column, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = held.schema["id"].dataType.simpleString()
    return held.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Words and code points of Arrow text columns, as flat numpy arrays.

Everything here works on a bounded slice of a batch (``SLICE_BYTES``, or one row if that is
longer), so memory in a task does not depend on how many rows Spark puts into a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20

#: White space of the word definition: tab to carriage return, and the blank.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

#: Bytes with A-Z in lower case, all others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of its texts pass ``limit``; every slice has a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Hand freed memory of this process back to the system: workers live on through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary array over the bytes between neighbouring offsets."""
    if len(offsets) < 2:
        return pa.array([], pa.large_binary())
    held = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, held)


class Words:
    """All words of the texts of a slice.

    ``words`` is a binary array; words of text i are ``first[i]`` to ``first[i + 1]``.
    ``starts`` are their byte offsets in the concatenated texts.
    """

    def __init__(self, texts: pa.Array, breaks: np.ndarray = SPACES, lower: bool = False):
        data, offsets = flat(texts)
        if lower:
            data = LOWER[data]
        inside = ~breaks[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edge = offsets[:-1][np.diff(offsets) > 0]
        opens[edge] = inside[edge]
        closes[edge[1:] - 1] = inside[edge[1:] - 1]
        self.starts = np.flatnonzero(opens)
        self.lengths = np.flatnonzero(closes) + 1 - self.starts
        self.first = np.searchsorted(self.starts, offsets)
        self.data = data[inside]
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = binary(self.offsets, self.data)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.empty(0, np.uint64)
        place = np.arange(len(self.data)) - np.repeat(self.offsets[:-1], self.lengths)
        value = (self.data.astype(np.uint64) + np.uint64(1)) * _powers(int(self.lengths.max()))[place]
        total = np.add.reduceat(value, self.offsets[:-1])
        return (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word's entry, distinct words)."""
        if not len(self.starts):
            return np.empty(0, np.int64), pa.array([], pa.large_binary())
        held = self.words.dictionary_encode()
        return held.indices.to_numpy().astype(np.int64), held.dictionary


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, … for every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for every i; empty ranges give zero."""
    before = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return before[first[1:]] - before[first[:-1]]


@cache
def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, simple lower case) for every code point."""
    letters = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            letters[point] = True
            small = char.lower()
            if len(small) == 1:
                lower[point] = ord(small)
    return letters, lower


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)

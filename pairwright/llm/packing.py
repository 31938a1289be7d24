"""Documents packed into windows of a fixed number of tokens by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.bpe_machine import MergeTable
from pairwright.llm.pretokens import Pieces, split_special
from pairwright.llm.texts import ranges, slices
from pairwright.llm.token_counts import read_vocabulary

#: Pieces, their bytes and their ids that a worker keeps.
MAX_KNOWN = 200_000
MAX_KNOWN_BYTES = 16 << 20
#: Remainders are planned and let go when a task holds this many ids; a remainder itself, however
#: short, counts as ``ROW_IDS`` more.
HELD_IDS = 1 << 23
ROW_IDS = 64
#: Text encoded at once; its code points and their states take some tens of bytes each.
SLICE_BYTES = 3 << 20
#: Sequence ids of a partition begin at its number times this.
SEQUENCES_PER_PARTITION = 1 << 33


class Encoder:
    """Token ids of whole texts, as the ``tokenizers`` library gives them.

    Each distinct piece is encoded once, by the ranked merges of the vocabulary. Those are run by
    ``tiktoken``, several times as fast for single pieces; it asks that the id of a merged token
    is its rank, which is checked.
    """

    def __init__(self, content: str):
        table = MergeTable(content)
        if any(joined != rank + 256 for rank, joined in table.merges.values()) or len(table.specials) > 1:
            raise ValueError("a vocabulary numbered by merge rank, with one special token at most, is asked for")
        self.special = table.specials[0] if table.specials else ""
        self.special_id = table.special_ids[0] if table.specials else -1
        self.piece_ids = tiktoken.Encoding(
            "pieces", pat_str=r"[\s\S]+", mergeable_ranks=table.ids, special_tokens={}
        )._encode_single_piece
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.ids = np.empty(1 << 20, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where in the pool the ids of each piece are; new pieces are added."""
        places = list(map(self.known.get, pieces))
        new = [i for i, at in enumerate(places) if at is None]
        if new:
            lists = [self.piece_ids(pieces[i]) for i in new]
            self.known_bytes += sum(len(pieces[i]) for i in new)
            ends = self.ends[-1] + np.cumsum([len(x) for x in lists])
            if ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(max(int(ends[-1]), len(self.ids)), np.uint32)])
            self.ids[self.ends[-1] : ends[-1]] = np.fromiter(chain.from_iterable(lists), np.uint32)
            for at, i in enumerate(new, len(self.ends) - 1):
                places[i] = self.known[pieces[i]] = at
            self.ends = np.concatenate([self.ends, ends])
        return np.array(places, np.int64)

    def encode(self, texts: pa.Array, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts); every text is followed by the id ``last``."""
        parts, first = texts, np.arange(len(texts) + 1)
        if self.special and pc.any(pc.match_substring(texts, self.special)).as_py():
            parts, first = split_special(texts.to_pylist(), self.special)
        if len(self.known) > MAX_KNOWN or self.known_bytes > MAX_KNOWN_BYTES:
            self._clear()
        held = Pieces(parts)
        coded = held.words.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        starts, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        before = np.concatenate([[0], np.cumsum(sizes)])
        edges = before[held.first]  # of the parts
        # Between two parts of a text stands the special token, after the last one ``last``.
        marks = np.full(len(parts), self.special_id, np.int64)
        marks[first[1:] - 1] = -1 if last is None else last
        wide = marks >= 0
        shifts = np.concatenate([[0], np.cumsum(wide)])
        out = np.empty(int(before[-1]) + int(wide.sum()), np.uint32)
        ids = self.ids[ranges(starts, sizes)]
        out[np.arange(len(ids)) + np.repeat(shifts[:-1], np.diff(edges))] = ids
        ends = edges[1:] + shifts[1:]
        out[ends[wide] - 1] = marks[wide]
        return out, np.concatenate([[0], ends[first[1:] - 1]])


@lru_cache(maxsize=2)
def encoder(content: str) -> Encoder:
    """One for each worker process, kept between its tasks."""
    return Encoder(content)


@dataclass
class Fill:
    """What a window holds: (length, how often), and its sum; repeated for ``times`` windows."""

    parts: list[tuple[int, int]]
    total: int
    times: int


def closest_fill(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The multiset of available lengths, the longest one in it, whose sum is closest to capacity.

    Subset sums are the bits of one integer; a length joins with its count split into powers of
    two. The search stops once the capacity itself is reached, and the counts are found by going
    back through the steps.
    """
    lengths = np.flatnonzero(counts)[::-1]
    seed = int(lengths[0])
    room, mask = capacity - seed, (1 << (capacity - seed + 1)) - 1
    reach, steps = 1, []
    for length in map(int, lengths):
        if length > room:
            continue
        left = min(int(counts[length]) - (length == seed), room // length)
        many = 1
        while left > 0:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            many *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def fills(counts: np.ndarray, capacity: int) -> Iterator[Fill]:
    """Fills until nothing is left; one fill serves as many windows as the counts allow."""
    counts = counts.copy()
    left = int((counts * np.arange(len(counts))).sum())
    while left:
        parts = closest_fill(counts, capacity)
        times = min(int(counts[length]) // used for length, used in parts)
        for length, used in parts:
            counts[length] -= used * times
        total = sum(length * used for length, used in parts)
        left -= total * times
        yield Fill(parts, total, times)


def plan_windows(lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows for pieces of the given lengths (each from 1 to ``capacity``).

    A window lists (piece, from, to). Windows that the fills leave short are filled up with what
    the last, least full windows hold, which is cut for it; what then remains makes one last
    run of tokens, cut into windows of a power of two each, which need no padding.
    """
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], np.arange(capacity + 2))
    taken = edges[:-1].copy()
    full, short = [], []
    for fill in fills(np.diff(edges), capacity):
        for _ in range(fill.times):
            window = []
            for length, used in fill.parts:
                at = taken[length]
                window += [(int(i), 0, length) for i in order[at : at + used]]
                taken[length] += used
            (full if fill.total == capacity else short).append((fill.total, window))
    short.sort(key=lambda w: -w[0])
    windows = [w for _, w in full]
    spare: list[tuple[int, int, int]] = []
    while short:
        total, window = short.pop(0)
        while total < capacity and (spare or short):
            if not spare:
                spare = short.pop()[1]
            piece, start, stop = spare.pop()
            room = min(capacity - total, stop - start)
            window.append((piece, start, start + room))
            total += room
            if start + room < stop:
                spare.append((piece, start + room, stop))
        if total == capacity:
            windows.append(window)
        else:
            spare = window
    while spare:
        size = sum(stop - start for _, start, stop in spare)
        size = 1 << (size.bit_length() - 1)
        window = []
        while size:
            piece, start, stop = spare.pop(0)
            room = min(size, stop - start)
            window.append((piece, start, start + room))
            size -= room
            if start + room < stop:
                spare.insert(0, (piece, start + room, stop))
        windows.append(window)
    return windows


_FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    capacity: int = 2048,
    end_id: int | None = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece of a document, with the sequence it lies in and its offset there.

    The ids of a document are those of the ``tokenizers`` library without special tokens added,
    then ``end_id``. Whole windows of a long document are sequences of their own; the remainders,
    at most ``capacity`` long, are packed by minimum bin slack among the documents of a partition
    of the scan, so nothing is shuffled and a partition's sequences depend on its rows only. All
    sequences hold ``capacity`` ids except the last few of a partition, whose lengths are powers of two.
    Null and empty texts give ``end_id`` alone (no row without one). Rows are packed one by one:
    repeated rows and null ids give pieces of their own, an empty table none. Other columns are
    not read. A task keeps ``HELD_IDS`` ids of remainders at most (or an eighth of a
    million short ones), then packs them.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    held = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = held.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(content.value)
        crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
        base = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        sequence = 0
        names, rests, sizes = [], [], []
        waiting = 0
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids, edges = encoding.encode(part.column("text"), end_id)
                keys = part.column("id")
                rows, out = [], []
                for i, (start, stop) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    size = stop - start
                    whole = size - size % capacity
                    for at in range(0, whole, capacity):
                        rows.append(i)
                        out.append((at, capacity, crc(ids[start + at : start + at + capacity]), size, base + sequence, 0))
                        sequence += 1
                    if whole < size:
                        names.append(keys[i])
                        rests.append(ids[start + whole : stop].copy())
                        sizes.append(size)
                        waiting += size - whole + ROW_IDS
                if rows:
                    yield _rows(keys.take(pa.array(rows)), out, id_column)
                if waiting >= HELD_IDS:
                    for made in packed(names, rests, sizes, base + sequence, keys.type):
                        yield made
                    sequence += len(rests) + capacity.bit_length()  # more than its windows
                    names, rests, sizes, waiting = [], [], [], 0
        if rests:
            yield from packed(names, rests, sizes, base + sequence, names[0].type)

    def packed(names, rests, sizes, sequence, id_type) -> Iterator[pa.RecordBatch]:
        crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
        lengths = np.array([len(r) for r in rests])
        rows, out = [], []
        for number, window in enumerate(plan_windows(lengths, capacity)):
            offset = 0
            for piece, start, stop in window:
                rows.append(piece)
                begun = sizes[piece] - int(lengths[piece]) + start
                out.append((begun, stop - start, crc(rests[piece][start:stop]), sizes[piece], sequence + number, offset))
                offset += stop - start
            if len(rows) >= 10_000:
                yield _rows(_taken(names, rows, id_type), out, id_column)
                rows, out = [], []
        if rows:
            yield _rows(_taken(names, rows, id_type), out, id_column)

    return held.mapInArrow(run, f"`{id_column}` {kind.simpleString()}, {_FIELDS}")


def _taken(names: list[pa.Scalar], rows: list[int], kind: pa.DataType) -> pa.Array:
    return pa.array([names[i].as_py() for i in rows], kind)


def _rows(ids: pa.Array, values: list[tuple], id_column: str) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*values)]
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([ids, *columns], [id_column, *names])

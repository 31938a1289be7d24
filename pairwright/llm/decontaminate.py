"""Benchmark passages inside documents, found by one Aho-Corasick automaton in one scan.

A window is ``width`` words of an item. The automaton does not hold all windows, which would write
every word of the benchmark ``width`` times, but the seeds: each item cut into runs of half as
many words. Any window holds a whole seed, so an occurrence of a window shows by one; from there
the words of the document and of the item are compared to both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.shared import stored
from pairwright.llm.texts import LOWER, ranges

#: Benchmark text in one automaton, which takes some 80 bytes for each of its bytes; a larger
#: benchmark takes several scans, one for each block.
BLOCK_BYTES = 2 << 20

#: Byte -> word byte in lower case, or a blank. Bytes of characters beyond ASCII are in words.
_WORD_BYTES = LOWER.copy()
for _byte in range(128):
    if not chr(_byte).isalnum():
        _WORD_BYTES[_byte] = 32
_TABLE = _WORD_BYTES.tobytes()


def normalised(text: str) -> bytes:
    """Words in lower case with a blank before and after each."""
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(_TABLE).split()) + b" "


def seed_words(width: int) -> tuple[int, int]:
    """(words of a seed, words that also agree at one side of it) for windows of ``width`` words.

    Wherever a window begins, the first seed to begin in it ends in it. The rest of the window
    lies at the two sides of the seed, so at least half of that at one of them.
    """
    size = (width + 1) // 2
    return size, (width - size + 1) // 2


class Passages:
    """The automaton over the seeds of all items, and over whole items too short for a window."""

    def __init__(self, items: tuple[tuple[str, str], ...], width: int):
        self.width = width
        self.size, self.side = seed_words(width)
        self.items: list[tuple[str, list[bytes]]] = []
        #: A seed with the words after it, or with those before it: where it stands in the items.
        self.after: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        self.before: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        whole: dict[bytes, set[str]] = {}
        seeds: set[bytes] = set()
        for name, text in items:
            words = normalised(text).split()
            if not words:
                continue
            if len(words) < width:
                whole.setdefault(_pattern(words), set()).add(name)
                continue
            number = len(self.items)
            self.items.append((name, words))
            for at in range(0, len(words) - self.size + 1, self.size):
                stop = at + self.size
                seeds.add(_pattern(words[at:stop]))
                if stop + self.side <= len(words):
                    self.after.setdefault(tuple(words[at : stop + self.side]), []).append((number, at))
                if at >= self.side:
                    self.before.setdefault(tuple(words[at - self.side : stop]), []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for pattern in seeds | whole.keys():
            names = tuple(sorted(whole.get(pattern, ())))
            self.automaton.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, names, pattern in seeds))
        self.empty = not (seeds or whole)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str], np.ndarray | None]:
        """(words, hit word ranges, items found, byte offsets of the words, if any is hit)."""
        line = normalised(text)
        n_words = line.count(b" ") - 1 if len(line) > 2 else 0
        found = [] if self.empty else list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return n_words, [], set(), None
        words = line.split()
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        stops = np.searchsorted(blanks, [at for at, _ in found]).tolist()
        names: set[str] = set()
        hits: list[tuple[int, int]] = []
        compared: dict[tuple[int, int], int] = {}  # item and shift: up to which word
        for stop, (_, (size, items, is_seed)) in zip(stops, found):
            start = stop - size
            if items:
                hits.append((start, stop))
                names.update(items)
            if is_seed:
                for number, at in self._places(words, start, stop):
                    if compared.get((number, start - at), 0) >= stop:
                        continue
                    name, own = self.items[number]
                    low, high = _agreement(words, start, stop, own, at)
                    compared[number, start - at] = high
                    if high - low >= self.width:
                        hits.append((low, high))
                        names.add(name)
        return n_words, hits, names, word_offsets(text) if hits else None

    def _places(self, words: list[bytes], start: int, stop: int) -> Iterator[tuple[int, int]]:
        """(item, place) of the seed where the words at one side agree as well."""
        yield from self.after.get(tuple(words[start : stop + self.side]), ())
        if start >= self.side:
            yield from self.before.get(tuple(words[start - self.side : stop]), ())


def _pattern(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def _agreement(words: list[bytes], start: int, stop: int, own: list[bytes], at: int) -> tuple[int, int]:
    """The longest run around ``[start, stop)`` in which the document and the item have the same words."""
    shift = start - at
    low, least = start, max(0, shift)
    while low > least and words[low - 1] == own[low - 1 - shift]:
        low -= 1
    high, most = stop, min(len(words), len(own) + shift)
    while high < most and words[high] == own[high - shift]:
        high += 1
    return low, high


def word_offsets(text: str) -> np.ndarray:
    """(start, stop) of every word in the text as it was, in code points."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    inside = np.concatenate([[False], _WORD_BYTES[data] != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return place[edges].reshape(-1, 2)


def hit_words(hits: list[tuple[int, int]]) -> np.ndarray:
    """The numbers of words in any of the ranges, each once, in order."""
    if not hits:
        return np.empty(0, np.int64)
    starts, stops = np.array(hits, np.int64).T
    return np.unique(ranges(starts, stops - starts))


@lru_cache(maxsize=1)
def passages(items: tuple[tuple[str, str], ...], width: int) -> Passages:
    """One for each worker process, kept between its tasks."""
    return Passages(items, width)


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int) -> Iterator[tuple]:
    """Benchmark items in blocks of bounded size, read one after the other."""
    rows = (
        benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text"))
        .where(F.col("item").isNotNull() & F.col("text").isNotNull())
        .distinct()
    )
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > block_bytes:
            yield tuple(sorted(block))
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"])
    yield tuple(sorted(block))


def _scanner(block: Broadcast, width: int) -> Callable[..., pa.Array]:
    def first(texts: pa.Array) -> pa.Array:
        machine = passages(block.value, width)
        return pa.array([_found(machine, text) for text in texts.to_pylist()], _ARROW)

    return first


def _further_scanner(block: Broadcast, width: int) -> Callable[..., pa.Array]:
    def further(texts: pa.Array, before: pa.Array) -> pa.Array:
        machine = passages(block.value, width)
        held = zip(texts.to_pylist(), before.to_pylist())
        return pa.array([_merged(earlier, _found(machine, text), text) for text, earlier in held], _ARROW)

    return further


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    out: str = "passages",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``out``: n_words, hits, items, spans.

    ``hits`` are the numbers of the words inside an occurrence of a window, ``spans`` the
    (start, stop) of runs of such words in the text as it was, in code points, and ``items`` the
    ids of the items with an occurring window. Texts and items are compared by their words in
    lower case (A-Z only); what stands between words does not count. Null and empty texts have
    no words and no hits; an item without words has no window; items with null id or text are
    left out; repeated items count once by id. An empty benchmark hits nothing.

    A benchmark larger than ``block_bytes`` is scanned in blocks, one automaton and one pass over
    ``docs`` each. What a pass has found is written to the shared folder before the next begins,
    so that no worker ever holds two automata. Nothing is shuffled.
    """
    kind = "struct<n_words:bigint,hits:array<int>,items:array<string>,spans:array<struct<start:int,stop:int>>>"
    spark = docs.sparkSession
    held = docs
    for number, block in enumerate(_blocks(benchmark, item_column, item_text_column, block_bytes)):
        sent = spark.sparkContext.broadcast(block)
        if not number:
            scan = F.arrow_udf(_scanner(sent, width), kind).asNondeterministic()
            held = held.withColumn(out, scan(F.col(text_column)))
        else:
            scan = F.arrow_udf(_further_scanner(sent, width), kind).asNondeterministic()
            held = stored(held, "passages").withColumn(out, scan(F.col(text_column), F.col(out)))
    return held


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


def _result(n_words: int, words: np.ndarray, items: list[str], offsets: np.ndarray | None) -> dict:
    spans = []
    if len(words):
        cuts = np.flatnonzero(np.diff(words) > 1) + 1
        for run in np.split(words, cuts):
            spans.append({"start": int(offsets[run[0], 0]), "stop": int(offsets[run[-1], 1])})
    return {"n_words": n_words, "hits": words.tolist(), "items": items, "spans": spans}


def _found(machine: Passages, text: str | None) -> dict:
    n_words, hits, names, offsets = machine.scan(text or "")
    return _result(n_words, hit_words(hits), sorted(names), offsets)


def _merged(one: dict, other: dict, text: str | None) -> dict:
    words = np.union1d(np.array(one["hits"], np.int64), np.array(other["hits"], np.int64))
    items = sorted({*one["items"], *other["items"]})
    return _result(one["n_words"], words, items, word_offsets(text or "") if len(words) else None)


def items_digest(items: str) -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.col(items), ","), 256)


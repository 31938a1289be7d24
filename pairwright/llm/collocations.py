"""Phrases of words that stand together more often than their parts explain, with exact counts.

Phrases are counted length by length. A phrase can be frequent only where both phrases one word
shorter inside it are, so that only places where these are frequent are counted at the next
length; which are frequent is told by a bitmap of checksums, of a size that is set and not by the
data, whose false alarms cost time only. The last two lengths share a pass. Before pairs and
triples are counted one by one they are counted by checksum, in one byte for each of a set number
of buckets that stops at the bound: a phrase can be frequent only where its bucket is. Texts are
read twice, to count words and to write their frequent words as ids; the rest reads the ids.

Within a task counts stand in a HAT-trie: nodes by word id above, and below them containers, hash
tables of the remaining ids, each of which bursts into a node when it gets too full. When the trie
as a whole is too large, its fullest subtrees are written out whole as sorted runs, one for each
partition of prefixes (the first word and a few parts of the second, so that one frequent word is
not one partition), where runs are merged and equal phrases become one.

A word's id is a 64-bit checksum of it. That no frequent word shares its id with another word of
the corpus is checked, and another seed is taken if one does, so counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.shared import stored
from pairwright.llm.texts import Words, binary, flat, give_back, slices

ID = 8
#: Characters that end a piece of text, and those that end a word besides.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BREAKS = PIECE_ENDS.copy()
BREAKS[[9, 32]] = True
UNDETERMINED = "und"
_SLICE = 2 << 20
#: Parts of the second word into which the subtree of a first word is dealt.
_PARTS = 16
#: Copies of the counts of single words and of words' texts in joins, which frequent words hit often.
_SALTS = 16


@dataclass(frozen=True)
class CollocationSettings:
    #: Words of a phrase at most, and occurrences at least.
    longest: int = 5
    least: int = 100
    #: A phrase is absorbed by a longer one with this share of its occurrences, in per cent.
    absorb: int = 100
    top: int = 2000
    #: Entries of a container before it bursts, and of the trie before subtrees are written out.
    burst: int = 4096
    held: int = 500_000
    #: Bits of a bitmap of frequent phrases at most, and buckets for pairs and triples: 2 to this power.
    most_bits: int = 27
    bucket_bits: int = 23


class HatTrie:
    """Counts of phrases of ``width`` ids. Below a node stand nodes or containers by the next id."""

    def __init__(self, width: int, burst: int = 4096):
        self.width, self.burst = width, burst
        self.children: dict[int, _Subtree] = {}
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def add(self, grams: np.ndarray) -> None:
        """Count the rows of a matrix of ids."""
        for head, rest in _by_first(grams):
            child = self.children.get(head)
            if child is None:
                child = self.children[head] = _Subtree(self.width - 1, self.burst)
            self.size -= child.size
            child.add(rest)
            self.size += child.size

    def spill(self, entries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out whole subtrees, the fullest first, until ``entries`` at most are left: sorted runs of
        (ids, counts)."""
        for head, child in sorted(self.children.items(), key=lambda c: (-c[1].size, c[0])):
            if self.size <= entries:
                return
            self.size -= child.size
            del self.children[head]
            ids, counts = child.entries()
            yield np.column_stack([np.full(len(ids), head, np.uint64), ids]), counts


class _Subtree:
    """A container of the remaining ids, or, once that was too full, a node."""

    def __init__(self, width: int, burst: int):
        self.width, self.burst = width, burst
        self.held: Counter | None = Counter()  # a single id as a number, several as bytes
        self.children: dict[int, _Subtree] = {}
        self.size = 0

    def add(self, grams: np.ndarray) -> None:
        if self.held is None:
            for head, rest in _by_first(grams):
                child = self._child(head)
                self.size -= child.size
                child.add(rest)
                self.size += child.size
            return
        self.held.update(self._keys(grams))
        self.size = len(self.held)
        if self.size > self.burst and self.width > 1:
            ids, counts = self.entries()
            self.held = None
            edges = _edges(ids[:, 0])
            for a, b in zip(edges[:-1], edges[1:]):
                child = self._child(int(ids[a, 0]))
                child.held = Counter(dict(zip(child._keys(ids[a:b, 1:]), counts[a:b].tolist())))
                child.size = b - a

    def _keys(self, grams: np.ndarray) -> list:
        if self.width == 1:
            return grams[:, 0].tolist()
        line, size = np.ascontiguousarray(grams).tobytes(), self.width * ID
        return [line[i : i + size] for i in range(0, len(line), size)]

    def _child(self, head: int) -> _Subtree:
        child = self.children.get(head)
        if child is None:
            child = self.children[head] = _Subtree(self.width - 1, self.burst)
        return child

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts), sorted by the ids."""
        if self.held is None:
            parts = [(head, *self.children[head].entries()) for head in sorted(self.children)]
            ids = [np.column_stack([np.full(len(i), head, np.uint64), i]) for head, i, _ in parts]
            return np.concatenate(ids), np.concatenate([n for _, _, n in parts])
        counts = np.fromiter(self.held.values(), np.int64, len(self.held))
        if self.width == 1:
            ids = np.fromiter(self.held.keys(), np.uint64, len(self.held))[:, None]
        else:
            ids = np.frombuffer(b"".join(self.held), np.uint64).reshape(-1, self.width)
        order = np.lexsort(ids.T[::-1])
        return ids[order], counts[order]


def _edges(values: np.ndarray) -> list[int]:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist()


def _by_first(grams: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first id, the other columns) of the rows of each first id."""
    if not len(grams):
        return
    grams = grams[np.argsort(grams[:, 0], kind="stable")]
    edges = _edges(grams[:, 0])
    rest = grams[:, 1:]
    for head, a, b in zip(grams[edges[:-1], 0].tolist(), edges[:-1], edges[1:]):
        yield head, rest[a:b]


def _mixed(ids: np.ndarray, width: int) -> np.ndarray:
    """A checksum of every run of ``width`` ids, for the bitmaps."""
    n = max(0, len(ids) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class _Text:
    """Word ids of the texts of a slice, with the language and the piece each word stands in."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int):
        words = Words(texts, BREAKS, lower=True)
        codes, self.distinct = words.coded()
        held = [xxhash.xxh64_intdigest(w, seed) for w in self.distinct.to_pylist()]
        self.codes, self.word_ids = codes, np.array(held, np.uint64)
        self.ids = self.word_ids[codes]
        ends = np.cumsum(PIECE_ENDS[flat(texts)[0]])
        self.row = row = np.repeat(np.arange(len(texts)), words.counts)
        # A new piece begins with a new text, or behind a character that ends one.
        passed = ends[words.starts] if len(words) else np.empty(0, np.int64)
        opens = np.concatenate([[True], (np.diff(row) > 0) | (np.diff(passed) > 0)]) if len(words) else np.empty(0, bool)
        self.piece = np.cumsum(opens)
        names = langs.dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        self.lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]

    def sums(self) -> np.ndarray:
        """The checksum of the language of each word."""
        return np.array([_lang_sum(x) for x in self.langs], np.uint64)[self.lang]


def _lang_sum(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1) | 1)


class Frequent:
    """Bitmap of phrases of one length that may be frequent, by language and checksum."""

    def __init__(self, width: int, bits: int, chunks: dict[int, bytes]):
        self.width, self.mask = width, np.uint64(bits - 1)
        self.held = np.zeros(max(bits // 8, 4096), np.uint8)
        for bucket, held in chunks.items():
            self.held[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(held)] = np.frombuffer(held, np.uint8)

    def slots(self, ids: np.ndarray, lang: np.ndarray | np.uint64) -> np.ndarray:
        mixed = (_mixed(ids, self.width) ^ (lang if np.isscalar(lang) else lang[: max(0, len(ids) - self.width + 1)])) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(20)) & self.mask

    def __call__(self, ids: np.ndarray, lang: np.ndarray) -> np.ndarray:
        at = self.slots(ids, lang)
        return (self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _frequent(grams: DataFrame, width: int, most_bits: int) -> Frequent:
    """The bitmap of a table of frequent (lang, gram): 32 bits for each, up to the set number."""
    count = grams.count()
    bits = 1 << min(most_bits, max(15, (32 * count).bit_length()))
    empty = Frequent(width, bits, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("gram").to_pylist()), np.uint64).reshape(-1, width)
            sums = np.array([_lang_sum(x) for x in batch.column("lang").to_pylist()], np.uint64)
            slots = np.array([empty.slots(row, s)[0] for row, s in zip(ids, sums)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64))], ["slot"])

    slots = grams.select("lang", "gram").mapInArrow(run, "slot long")
    return Frequent(width, bits, _bitmap(slots))


def _bitmap(slots: DataFrame) -> dict[int, bytes]:
    """Chunks of 4 KB by number: at most one for each 32,768 bits of the set size."""
    place = F.col("slot") + 1  # the engine numbers bits from 1
    chunks = slots.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held")
    )
    return {r["bucket"]: bytes(r["held"]) for r in chunks.collect()}


_CHUNK = 1 << 16


class _Buckets:
    """Occurrences of phrases of one length by checksum, and where these are frequent over all tasks.

    Each task hands on a byte for each bucket that stops at the bound; counts for a bound over 127
    are first divided by a power of two and rounded up. Sums reach the bound wherever the true sums do.
    """

    def __init__(self, width: int, least: int, bits: int):
        self.width, self.bits = width, bits
        self.shift = max(0, least.bit_length() - 7)
        self.most = -(-least >> self.shift)
        self.blank = Frequent(width, 1 << bits, {})

    def zeros(self) -> np.ndarray:
        return np.zeros(1 << self.bits, np.int32)

    def count(self, counts: np.ndarray, ids: np.ndarray, sums: np.ndarray, inside: np.ndarray) -> None:
        found, n = np.unique(self.blank.slots(ids, sums)[inside], return_counts=True)
        counts[found] += n.astype(np.int32)

    def chunks(self, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        held = np.minimum(-(-counts >> self.shift), self.most).astype(np.uint8)
        for number, begin in enumerate(range(0, len(held), _CHUNK)):
            chunk = held[begin : begin + _CHUNK]
            if chunk.any():
                yield number, chunk.tobytes()

    def frequent(self, chunks: DataFrame) -> Frequent:
        """The bitmap of a table (chunk, held) of all tasks."""
        most = self.most

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, total = None, None

            def slots() -> pa.RecordBatch:
                at = np.flatnonzero(total >= most) + number * _CHUNK
                return pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["slot"])

            for batch in batches:
                for chunk, held in zip(batch.column("chunk").to_pylist(), batch.column("held")):
                    if chunk != number:
                        if number is not None:
                            yield slots()
                        number, total = chunk, np.zeros(_CHUNK, np.int64)
                    part = np.frombuffer(held.as_buffer(), np.uint8)
                    total[: len(part)] += part
            if number is not None:
                yield slots()

        ordered = chunks.select("chunk", "held").repartition("chunk").sortWithinPartitions("chunk")
        return Frequent(self.width, 1 << self.bits, _bitmap(ordered.mapInArrow(add, "slot long")))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"), text.alias("text"))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, gram, n): every word with its id and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                made = _Text(part.column("text"), part.column("lang"), seed)
                size = max(1, len(made.distinct))
                pairs, n = np.unique(made.lang * size + made.codes, return_counts=True)
                at = pairs % size
                columns = [
                    pa.array(made.langs, pa.string()).take(pa.array(pairs // size)),
                    made.distinct.take(pa.array(at)).cast(pa.large_string()).cast(pa.string()),
                    binary(np.arange(len(at) + 1) * ID, made.word_ids[at].view(np.uint8)).cast(pa.binary()),
                    pa.array(n, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "gram", "n"])

    counted = texts.mapInArrow(run, "lang string, word string, gram binary, n long")
    return counted.groupBy("lang", "word").agg(F.first("gram").alias("gram"), F.sum("n").alias("n"))


def _clash(words: DataFrame, least: int) -> bool:
    """Whether a word that is frequent in a language shares its id with another word, or with a break."""
    by_word = words.groupBy("gram", "word").agg(F.max("n").alias("n"))
    by_id = by_word.groupBy("gram").agg(F.count("*").alias("words"), F.max("n").alias("n"))
    taken = (F.col("words") > 1) | (F.col("gram") == F.lit(bytes(ID)))  # 0 stands for a break
    return not by_id.where(taken & (F.col("n") >= least)).isEmpty()


_ENCODED = "lang string, ids array<long>, chunk long, held binary"


def encode(texts: DataFrame, words: Frequent, buckets: _Buckets, seed: int) -> DataFrame:
    """Texts as (lang, ids): frequent words that stand beside another, with 0 where others or an end of a
    piece come between, and rows (chunk, held) with the pairs of each task by bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int64())), ("chunk", pa.int64()), ("held", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value, buckets.zeros()
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                made = _Text(part.column("text"), part.column("lang"), seed)
                if len(made.ids) < 2:
                    continue
                sums = made.sums()
                whole = known(made.ids, sums)
                tied = (made.piece[:-1] == made.piece[1:]) & whole[:-1] & whole[1:]
                buckets.count(counts, made.ids, sums, tied)
                kept = np.flatnonzero(np.concatenate([tied, [False]]) | np.concatenate([[False], tied]))
                if not len(kept):
                    continue
                # A word is followed by 0 if it is not tied to the next one.
                ends = ~np.concatenate([tied, [False]])[kept]
                at = np.arange(len(kept)) + np.cumsum(ends) - ends
                line = np.zeros(len(kept) + int(ends.sum()), np.int64)
                line[at] = made.ids[kept].view(np.int64)
                row = made.row[kept]
                first = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
                edges = np.append(at[first], len(line)).astype(np.int32)
                langs = part.column("lang").take(pa.array(row[first]))
                none = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(line))
                yield pa.RecordBatch.from_arrays([langs, lists, *none], schema=schema)
        for number, held in buckets.chunks(counts):
            yield pa.RecordBatch.from_pylist([{"chunk": number, "held": held}], schema)

    return texts.mapInArrow(run, _ENCODED)


def _slices_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(ids, whether the phrase may not go on behind a place, language of each place, names of languages)."""
    for batch in batches:
        sizes = batch.column("ids").value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + (1 << 19), "right")))
            part = batch.slice(start, stop - start)
            ids = part.column("ids").flatten().to_numpy().view(np.uint64)
            names = part.column("lang").dictionary_encode()
            lang = np.repeat(names.indices.to_numpy().astype(np.int64), sizes[start:stop])
            yield ids, np.cumsum(ids == 0), lang, names.dictionary.to_pylist()
            start = stop
    give_back()


def _lang_sums(langs: list[str], lang: np.ndarray) -> np.ndarray:
    return np.array([_lang_sum(x) for x in langs], np.uint64)[lang]


def _inside(ids: np.ndarray, breaks: np.ndarray, sums: np.ndarray, width: int, known: list[Frequent]) -> np.ndarray:
    """Where a phrase of ``width`` ids begins whose parts may all be frequent."""
    n = max(0, len(ids) - width + 1)
    inside = (breaks[:n] == breaks[width - 1 :]) & (ids[:n] != 0) if n else np.zeros(0, bool)
    for part in known:
        found = part(ids, sums)
        for k in range(width - part.width + 1):
            inside &= found[k : k + n]
    return inside


def bucket_phrases(encoded: DataFrame, known: list[Frequent], buckets: _Buckets) -> Frequent:
    """The buckets of phrases that occur often enough, among those whose parts may be frequent."""
    sent = encoded.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = buckets.zeros()
        for ids, breaks, lang, langs in _slices_of_ids(batches):
            sums = _lang_sums(langs, lang)
            inside = _inside(ids, breaks, sums, buckets.width, sent.value)
            if inside.any():
                buckets.count(counts, ids, sums, inside)
        for number, held in buckets.chunks(counts):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held], pa.binary())], ["chunk", "held"])

    return buckets.frequent(encoded.mapInArrow(run, "chunk long, held binary"))


def count_phrases(encoded: DataFrame, widths: list[int], known: list[Frequent], settings: CollocationSettings) -> DataFrame:
    """(lang, gram, n) of the phrases of ``widths`` words all of whose parts as long as those of
    ``known`` may be frequent, and that occur ``least`` times or more."""
    sent = encoded.sparkSession.sparkContext.broadcast(known)
    burst, held = settings.burst, settings.held
    partitions = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[str, int], HatTrie] = {}

        def runs(left: int) -> Iterator[pa.RecordBatch]:
            """What is over the share of each trie in ``left`` entries, as a sorted run for each prefix partition."""
            total = max(1, sum(map(len, tries.values())))
            for (lang, width), trie in sorted(tries.items()):
                spilled = list(trie.spill(left * len(trie) // total))
                if spilled:
                    ids, n = np.concatenate([i for i, _ in spilled]), np.concatenate([n for _, n in spilled])
                    order = np.lexsort(ids.T[::-1])
                    yield _run_rows(lang, ids[order], n[order], partitions)

        for ids, breaks, lang, langs in _slices_of_ids(batches):
            sums = _lang_sums(langs, lang)
            for width in widths:
                starts = np.flatnonzero(_inside(ids, breaks, sums, width, sent.value))
                of = lang[starts]
                for code in np.unique(of).tolist():
                    at = starts[of == code]
                    trie = tries.setdefault((langs[code], width), HatTrie(width, burst))
                    trie.add(ids[at[:, None] + np.arange(width)])
            if sum(map(len, tries.values())) > held:
                yield from runs(held // 2)
        yield from runs(0)

    spilled = encoded.mapInArrow(run, _RUNS).repartition("part").sortWithinPartitions("part", "lang", "width")
    least = settings.least

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size = None, [], 0

        def frequent() -> pa.RecordBatch:
            ids, n = _summed(held)
            ids, n = ids[n >= least], n[n >= least]
            grams = binary(np.arange(len(n) + 1) * ids.shape[1] * ID, ids.view(np.uint8).ravel()).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([group[1]] * len(n), pa.string()), grams, pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            columns = (batch.column(c) for c in ("part", "lang", "width", "ids", "counts"))
            for part, lang, width, ids, counts in zip(*columns):
                key = part.as_py(), lang.as_py(), width.as_py()
                if key != group:
                    if held:
                        yield frequent()
                    group, held, size = key, [], 0
                rows = np.frombuffer(ids.as_buffer(), np.uint64).reshape(-1, key[2])
                held.append((rows, np.frombuffer(counts.as_buffer(), np.int64)))
                size += len(rows)
                if size > _MERGED:  # equal phrases of runs so far become one
                    held = [_summed(held)]
                    size = min(len(held[0][1]), _MERGED // 2)
        if held:
            yield frequent()

    return spilled.mapInArrow(merge, "lang string, gram binary, n long")


_RUNS = "part int, lang string, width int, ids binary, counts binary"
#: Entries of runs that are held before equal ones are merged.
_MERGED = 1 << 20


def _run_rows(lang: str, ids: np.ndarray, n: np.ndarray, partitions: int) -> pa.RecordBatch:
    """Sorted entries as a run for each prefix partition: by the first id and a few parts of the second, so
    that one frequent word is not one partition."""
    slice_ = _mixed(ids[:, 1], 1) % np.uint64(_PARTS)
    part = (_mixed(ids[:, 0] + slice_, 1) % np.uint64(partitions)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, ids, n = part[order], np.ascontiguousarray(ids[order]), np.ascontiguousarray(n[order])
    edges = _edges(part)
    cut = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())
    size = len(edges) - 1
    columns = [pa.array(part[edges[:-1]]), pa.array([lang] * size), pa.array(np.full(size, ids.shape[1], np.int32)), cut(ids), cut(n)]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _RUNS.split(", ")])


def _summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of (ids, counts) as one, sorted, with equal ids once."""
    ids, n = np.concatenate([i for i, _ in runs]), np.concatenate([n for _, n in runs])
    order = np.lexsort(ids.T[::-1])
    ids, n = ids[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
    return np.ascontiguousarray(ids[first]), np.add.reduceat(n, first)


def _width(gram: str = "gram") -> Column:
    return (F.octet_length(gram) / ID).cast("int")


def _part(gram: Column, first: Column, words: Column) -> Column:
    return F.substring(gram, first * ID + 1, words * ID)


def _absorbed(grams: DataFrame, settings: CollocationSettings) -> DataFrame:
    """(lang, gram) of candidates that lie in a longer one of almost as many occurrences."""
    n = _width()
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), n - 1),
            lambda size: F.transform(F.sequence(F.lit(0), n - size), lambda first: _part(F.col("gram"), first, size)),
        )
    )
    held = grams.where(n > 2).select("lang", F.explode(inner).alias("gram"), F.col("n").alias("longer"))
    most = held.groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    within = grams.join(most, ["lang", "gram"]).where(100 * F.col("longer") >= settings.absorb * F.col("n"))
    return within.select("lang", "gram")


def _cut(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with l, r, total and score of the cut of the lowest score.

    Counts of single words, of which one may be part of very many candidates, are copied for
    each of a few salts.
    """
    salt = lambda gram: F.when(F.octet_length(gram) == ID, F.pmod(F.xxhash64("whole"), F.lit(_SALTS))).otherwise(F.lit(0).cast("long"))
    cut = F.explode(F.sequence(F.lit(1), _width() - 1)).alias("k")
    cuts = candidates.select("lang", F.col("gram").alias("whole"), "n", cut)
    whole, k = F.col("whole"), F.col("k")
    sides = F.explode(
        F.array(
            F.struct(F.lit(True).alias("left"), _part(whole, F.lit(0), k).alias("gram")),
            F.struct(F.lit(False).alias("left"), _part(whole, k, _width("whole") - k).alias("gram")),
        )
    )
    parts = cuts.select("lang", "whole", "n", "k", sides.alias("s")).select("lang", "whole", "n", "k", "s.left", "s.gram")
    salts = F.when(F.octet_length("gram") == ID, F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).otherwise(
        F.array(F.lit(0).cast("long"))
    )
    known = counts.select("lang", "gram", F.col("n").alias("f"), F.explode(salts).alias("salt"))
    met = parts.withColumn("salt", salt("gram")).join(known, ["lang", "gram", "salt"])
    both = met.groupBy("lang", "whole", "n", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    both = both.join(F.broadcast(totals), "lang") if totals.count() <= 10_000 else both.join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    top, bottom = F.lit(1000).cast("decimal(4,0)") * exact("n") * exact("total"), exact("l") * exact("r")
    scored = both.withColumns({"_top": top.cast("decimal(38,0)"), "_bottom": bottom.cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("_top div _bottom"))
    lowest = scored.groupBy("lang", "whole").agg(F.min(F.struct("score", "k", "l", "r", "n", "total")).alias("c"))
    return lowest.select("lang", F.col("whole").alias("gram"), "c.*")


def _spelled(scored: DataFrame, words: DataFrame) -> DataFrame:
    """``scored`` with ``phrase``, the words of ``gram`` joined by blanks."""
    salt = F.pmod(F.xxhash64("gram"), F.lit(_SALTS))
    places = F.transform(
        F.sequence(F.lit(0), _width() - 1), lambda i: F.struct(i.alias("place"), _part(F.col("gram"), i, F.lit(1)).alias("id"))
    )
    each = scored.select("lang", "gram", salt.alias("salt"), F.explode(places).alias("p")).select("lang", "gram", "salt", "p.place", F.col("p.id").alias("id"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))
    named = words.select("lang", F.col("gram").alias("id"), "word", salts.alias("salt"))
    joined = each.join(named, ["lang", "id", "salt"]).groupBy("lang", "gram").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda s: s["word"]), " ").alias("phrase")
    )
    return scored.join(joined, ["lang", "gram"])


def collocations(docs: DataFrame, settings: CollocationSettings = CollocationSettings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language of the highest scores.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line breaks, pieces into words
    at blanks and tabs; phrases lie within pieces, occurrences may overlap. n counts all words of the
    language, a, l and r the phrase and the two parts of its cut. The score is floor(1000 a n / (l r)) of the
    cut that has it lowest, of equal ones the first. Ties of score and a are ranked by the phrase.

    A null text is empty, a null language is ``und``, repeated rows count each time, an empty
    table gives an empty result; other columns are not read. Whole texts are counted.
    """
    if settings.longest < 2 or settings.least < 1 or min(settings.most_bits, settings.bucket_bits) < 16:
        raise ValueError("phrases have two words or more, occur once or more, and a bitmap has 2 ** 16 bits or more")
    texts = _texts(docs)
    seed = 0
    while True:
        words = stored(word_counts(texts, seed), "words")
        if not _clash(words, settings.least):
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.where(F.col("n") >= settings.least)
    levels = [often.select("lang", "gram", "n")]
    pairs = _Buckets(2, settings.least, settings.bucket_bits)
    made = stored(encode(texts, _frequent(levels[0], 1, settings.most_bits), pairs, seed), "ids")
    encoded = made.where(F.col("chunk").isNull()).select("lang", "ids")
    known = [pairs.frequent(made.where(F.col("chunk").isNotNull()))]
    width = 1
    while width < settings.longest:
        # The last two lengths share a pass.
        widths = [width + 1] if width + 1 < settings.longest - 1 or settings.longest < 4 else list(range(width + 1, settings.longest + 1))
        levels.append(stored(count_phrases(encoded, widths, known, settings), f"phrases-{widths[0]}"))
        width = widths[-1]
        if width < settings.longest:
            known = [_frequent(levels[-1], width, settings.most_bits)]
            if width == 2:
                triples = _Buckets(3, settings.least, settings.bucket_bits)
                known.append(bucket_phrases(encoded, known, triples))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    grams = counts.where(F.octet_length("gram") > ID)
    candidates = grams.join(_absorbed(grams, settings), ["lang", "gram"], "left_anti")
    spelled = _spelled(_cut(candidates, counts, totals), often)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= settings.top)
    return ranked.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")

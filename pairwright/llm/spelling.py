"""Spelling variants: words one inserted, deleted or replaced letter apart, by pairs of trie nodes.

All words make two tries, of their letters forward and backward, whose nodes are numbered. A word
and a place in it then are two integers: the node of what stands before and the node of what
stands behind. Skipping the letter at a place gives one pair, skipping none gives another. Words
that share a pair with a letter skipped differ in that letter alone; a word whose pair without a
skip equals a pair of another with a skip lacks that letter. So neighbours meet in a join of
integer pairs, exactly, without comparing letters.

A pair's group has at most one word for each letter of the alphabet and one without a skip. No
pairs of words are made: each member learns the number and the best of the others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.shared import stored
from pairwright.llm.texts import flat

#: A node's number is that of its partition and its place there.
_PLACE_BITS = 40


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, their numbers)."""
    data, _ = flat(words)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))
    _, edges = flat(words)
    return points, np.diff(lead[edges])


def _shared(points: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letters that each word but the first has in common with the one before."""
    out = np.zeros(len(size), np.int64)
    open_ = np.arange(1, len(size))
    depth = 0
    while len(open_) > 8:
        open_ = open_[(size[open_ - 1] > depth) & (size[open_] > depth)]
        open_ = open_[points[first[open_ - 1] + depth] == points[first[open_] + depth]]
        depth += 1
        out[open_] = depth
    for k in open_:
        most = min(size[k - 1], size[k])
        differ = np.flatnonzero(points[first[k - 1] : first[k - 1] + most] != points[first[k] : first[k] + most])
        out[k] = differ[0] if len(differ) else most
    return out


class _Numbering:
    """Numbers the nodes on the path of each word of a partition, words coming in order.

    A node is named by the first word that passes it: the place where that word begins in the line
    of all words of the partition (each with one place more than letters) and the depth.
    """

    def __init__(self, partition: int):
        self.base = partition << _PLACE_BITS
        self.place = 0
        self.last: tuple[np.ndarray, np.ndarray] | None = None

    def paths(self, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, nodes of all paths, each with the root, which is 0)."""
        first = np.cumsum(size) - size
        shared = _shared(points, first, size)
        if self.last is not None and len(size):
            before = self.last[0]
            most = min(len(before), int(size[0]))
            differ = np.flatnonzero(before[:most] != points[:most])
            shared[0] = differ[0] if len(differ) else most
        places = self.place + np.cumsum(size + 1) - (size + 1)
        at = np.cumsum(size + 1) - (size + 1)
        nodes = np.zeros(int((size + 1).sum()), np.int64)
        open_ = np.flatnonzero(size >= 1)
        depth = 0
        while len(open_):
            depth += 1
            made = np.where(shared[open_] < depth, np.arange(len(open_)), -1)
            by = np.maximum.accumulate(made)
            number = self.base + places[open_[by]] + depth
            if by[0] < 0:
                number = np.where(by < 0, self.last[1][depth], number)
            nodes[at[open_] + depth] = number
            open_ = open_[size[open_] > depth]
        if len(size):
            self.last = points[first[-1] :].copy(), nodes[at[-1] :].copy()
            self.place = int(places[-1] + size[-1] + 1)
        return places, nodes


def _numbered(words: DataFrame, key: Column, path: str) -> DataFrame:
    """``words`` with ``path``, the numbered nodes of ``key`` from the root on, and its code points.

    Words are sorted over all partitions and numbered where they stand. Only the first and the
    last word of each partition come to the driver, to hand on the numbers of nodes that begin
    in an earlier partition. Keys have to be distinct.
    """
    ordered = words.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        numbering = _Numbering(partition)
        for batch in batches:
            points, size = _points(batch.column("_key"))
            places, nodes = numbering.paths(points, size)
            ends = np.concatenate([[0], np.cumsum(size)])
            lists = lambda values, edges: pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), values).cast(pa.list_(values.type))
            made = [
                pa.array(np.full(len(size), partition, np.int32)),
                pa.array(places),
                lists(pa.array(nodes), ends + np.arange(len(ends))),
                lists(pa.array(points.astype(np.int32)), ends),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_part", "_place", path, "_points"])

    made = stored(ordered.mapInArrow(run, f"{kinds}, _part int, _place long, {path} array<long>, _points array<int>"), f"trie-{path}")
    edges = made.groupBy("_part").agg(
        F.min(F.struct("_place", "_key")).alias("first"), F.max(F.struct("_place", "_key", path)).alias("last")
    )
    rows, word, nodes = [], None, []
    for r in sorted(edges.collect(), key=lambda r: r["_part"]):
        handed = nodes[1 : len(os.path.commonprefix([word, r["first"]["_key"]])) + 1] if word is not None else []
        rows.append((r["_part"], handed))
        word, base = r["last"]["_key"], r["_part"] << _PLACE_BITS
        nodes = [handed[d - 1] if 0 < d <= len(handed) and x == base + d else x for d, x in enumerate(r["last"][path])]
    handed = F.broadcast(made.sparkSession.createDataFrame(rows, "_part int, _handed array<long>"))
    base = F.shiftleft(F.col("_part").cast("long"), _PLACE_BITS)
    own = lambda x, d: (d > 0) & (d <= F.size("_handed")) & (x == base + d)
    final = F.transform(path, lambda x, d: F.when(own(x, d), F.get("_handed", d - 1)).otherwise(x))
    return made.join(handed, "_part").select(*words.columns, final.alias(path), "_points")


def _pairs(tries: DataFrame) -> DataFrame:
    """(before, behind, whole, letter, n, word): a row for every letter skipped and every place between."""
    n = F.size("points")
    skipped = F.transform(
        "points",
        lambda c, i: F.struct(F.get("fore", i).alias("before"), F.get("back", n - 1 - i).alias("behind"), F.lit(False).alias("whole"), c.alias("letter")),
    )
    between = F.transform(
        "fore",
        lambda p, i: F.struct(p.alias("before"), F.get("back", n - i).alias("behind"), F.lit(True).alias("whole"), F.coalesce(F.get("points", i), F.lit(-1)).alias("letter")),
    )
    return tries.select("n", "word_id", F.explode(F.concat(skipped, between)).alias("k")).select("k.*", "n", "word_id")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(word_id, n_near, best): how many words are near, and the most frequent with its count.

    A letter beside an equal one can be inserted at several places to the same effect; only the
    last counts, where the letter that follows differs.
    """
    by = Window.partitionBy("before", "behind")
    placed = by.orderBy("whole", F.desc("n"), "word_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Larger is better: by count, then by the order of words, in which ids are given.
    one = F.struct("n", (-F.col("word_id")).alias("order"), "letter", "whole")
    met = pairs.select(
        "*",
        F.count("*").over(placed).alias("size"),
        F.first(one).over(placed).alias("one"),
        F.nth_value(one, 2).over(placed).alias("two"),
        F.last(one).over(placed).alias("end"),
    ).where(F.col("size") > 1)
    short = F.when(F.col("end.whole"), F.col("end"))
    skips = F.col("size") - F.when(F.col("end.whole"), 1).otherwise(0)
    follows = F.max(~F.col("whole") & (F.col("letter") == F.col("end.letter"))).over(by)
    met = met.select("*", short.alias("short"), skips.alias("skips"), follows.alias("follows"))
    reached = F.col("short").isNotNull() & (F.col("short.letter") != F.col("letter"))
    another = lambda c: F.when(~F.col(f"{c}.whole"), F.col(c))
    other = F.when(F.col("one.order") == -F.col("word_id"), another("two")).otherwise(another("one"))
    unlike = F.when(F.col("one.letter") == F.col("letter"), another("two")).otherwise(another("one"))
    near = F.when(F.col("whole"), F.col("skips") - F.col("follows").cast("int")).otherwise(F.col("skips") - 1 + reached.cast("int"))
    best = F.when(F.col("whole"), unlike).otherwise(F.greatest(other, F.when(reached, F.col("short"))))
    told = met.select("word_id", near.cast("long").alias("near"), best.alias("best")).where(F.col("near") > 0)
    return told.groupBy("word_id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best.n", "best.order")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word_id, root): the end of the chain of forms. Steps are doubled, so that rounds grow with the
    logarithm of the longest chain; counts grow tenfold at each step, so chains are short and have no rings."""
    steps = stored(forms, "forms")
    while True:
        ahead = steps.select(F.col("word_id").alias("root"), F.col("root").alias("next"))
        jumped = stored(steps.join(ahead, "root", "left").select("word_id", "root", "next"), "forms")
        steps = jumped.select("word_id", F.coalesce("next", "root").alias("root"))
        if jumped.where(F.col("next").isNotNull()).isEmpty():
            return steps


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every distinct word of a table (word, n).

    Near are words that differ by exactly one inserted, deleted or replaced code point. ``form`` is
    the near word of the largest count, of equal counts the first in the order of code points,
    if it is ``ratio`` (2 or more) times as frequent or more, else null; ``root`` is the last word on the way
    over forms, the word itself without a form. Counts of repeated words are summed up, null words
    are left out, the empty word is a word; an empty table gives an empty result; other columns
    are left out. Rows grow with the letters of all distinct words, also for very long ones.
    """
    if ratio < 2:
        raise ValueError("a form has to be at least twice as frequent")
    distinct = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    fore = _numbered(distinct, F.col("word"), "fore").withColumnRenamed("_points", "points")
    tries = _numbered(fore.withColumn("word_id", F.element_at("fore", -1)), F.reverse("word"), "back").drop("_points")
    tries = stored(tries, "tries")
    near = _neighbours(_pairs(tries))
    named = tries.select("word_id", "word", "n")
    known = stored(
        named.join(near, "word_id", "left").select(
            "word_id",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"),
        ),
        "near-words",
    )
    formed = known.where(F.col("best").isNotNull())
    roots = _roots(formed.select("word_id", (-F.col("best.order")).alias("root")))
    texts = known.select(F.col("word_id").alias("form_id"), F.col("word").alias("form"))
    ends = known.select(F.col("word_id").alias("root"), F.col("word").alias("last"))
    full = (
        formed.withColumn("form_id", -F.col("best.order"))
        .join(texts, "form_id")
        .join(roots, "word_id")
        .join(ends, "root")
        .select("word", "form", F.col("last").alias("root"), "n", "n_near", F.col("best.n").alias("form_n"))
    )
    plain = known.where(F.col("best").isNull()).select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n")
    )
    return full.unionByName(plain)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))

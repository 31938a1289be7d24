"""Near-duplicates by 64-bit SimHash fingerprints, with candidates from pigeonring filtering.

A fingerprint is five segments in a ring. If two fingerprints differ in at most ``MOST`` = 2 bits,
some segment begins a chain in which, for every length l, the first l segments together differ
in at most l * 2 / 5 bits: none in the first two, at most one in the first three and in the first
four, at most two in all. So of the third and fourth segment one at least is equal as well. Three
equal segments, 38 or 39 bits, are a key; fingerprints that share one are candidates. The chain is
then followed segment by segment before whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.components import components
from pairwright.llm.shared import stored
from pairwright.llm.texts import LOWER, flat, slices

MOST = 2
#: (first bit, bits) of the segments, from the lowest bit on.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints in one key up to which all pairs in it are compared.
CROWDED = 64


def _words_of(text: bytes) -> list[bytes]:
    return text.split()  # white space of ``bytes`` is exactly that of the word definition


def _hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    words = _words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), stops[width - 1 :].tolist())), np.uint64, n
    )


def _fingerprints(texts: pa.Array, width: int, seed: int) -> np.ndarray:
    data, edges = flat(texts)
    lowered = LOWER[data].tobytes()
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, (start, stop) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        hashes = _hashes(lowered[start:stop], width, seed)
        if not len(hashes):
            continue
        ones = np.zeros(64, np.int64)
        for begin in range(0, len(hashes), 1 << 16):
            part = hashes[begin : begin + (1 << 16)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[ones * 2 > len(hashes)].sum(dtype=np.uint64)
    return out


def fingerprints(
    docs: DataFrame, width: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, fp long): the fingerprint of the whole text in lower case (A-Z), as a signed number.

    Shingles are ``width`` words, repeats included, joined by blanks; a shorter text is one
    shingle, a null text or one without words has fingerprint 0.
    """
    held = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = _fingerprints(part.column("text"), width, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made)], ["id", "fp"])

    return held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, fp long")


def _segment(fp: Column, number: int) -> Column:
    first, bits = SEGMENTS[number % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: for each start of a chain, its first two segments with the
    third or with the fourth."""
    made = []
    for start in range(len(SEGMENTS)):
        for third in (2, 3):
            parts = F.lit(start * 2 + third - 2).cast("long")
            for step in (0, 1, third):
                parts = F.shiftleft(parts, SEGMENTS[(start + step) % len(SEGMENTS)][1]).bitwiseOR(_segment(fp, start + step))
            made.append(F.struct(parts.alias("key"), F.lit(start).alias("start")))
    return F.explode(F.array(*made))


def _chain_holds(a: Column, b: Column, start: Column) -> Column:
    """Whether the chain from ``start`` stays within its budget at every length."""
    differ = a.bitwiseXOR(b)
    held = F.lit(False)
    n = len(SEGMENTS)
    for first in range(n):
        spent, within = F.lit(0), F.lit(True)
        for length in range(1, n + 1):
            spent = spent + F.bit_count(_segment(differ, first + length - 1))
            within = within & (spent <= length * MOST // n)
        held = F.when(start == first, within).otherwise(held)
    return held


def links(distinct: DataFrame, label: str = "simhash") -> DataFrame:
    """(a, b) links between fingerprints that differ in at most two bits, of a table of distinct
    (fp, rep): every two such fingerprints are in one component of the links.

    Pairs of a key with up to ``CROWDED`` fingerprints follow the chain and are then compared
    whole. Fingerprints of a fuller key take the way of their neighbours instead: each stands
    under itself and all numbers one bit away. Two of them share such a number exactly if they
    differ in at most two bits, and at most 65 share one, so they are linked to its least. No
    key ever makes all pairs of a large group.
    """
    keyed = distinct.select("fp", "rep", _keys(F.col("fp")).alias("k")).select("fp", "rep", "k.key", "k.start")
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    crowds = stored(crowds.select("key", (F.col("n") > CROWDED).alias("crowded")), label)
    shared = keyed.join(crowds, "key")
    few = shared.where(~F.col("crowded")).drop("crowded")
    other = few.select("key", F.col("fp").alias("fp_b"), F.col("rep").alias("rep_b"))
    pairs = (
        few.join(other, "key")
        .where(F.col("rep") < F.col("rep_b"))
        .where(_chain_holds(F.col("fp"), F.col("fp_b"), F.col("start")))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= MOST)
        .select(F.col("rep_b").alias("a"), F.col("rep").alias("b"))
    )
    many = shared.where("crowded").select("fp", "rep").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)]]
    near = many.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("near"))
    least = near.groupBy("near").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where(F.col("n") > 1)
    stars = near.join(least, "near").where(F.col("rep") != F.col("b")).select(F.col("rep").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, fp, component): each row with its fingerprint and the smallest id reachable over links.

    Documents are linked when their fingerprints differ in at most two bits; texts without words
    have fingerprint 0 and are linked like any other. Rows that repeat an id are
    rows of their own: each is placed by its own text. Rows with a null id are linked to nothing and have a null component. An
    empty table gives an empty result. Only the id and the text are read.

    Equal fingerprints are one node, so that copies cost one row each; the table of ids and
    fingerprints is written once to the shared folder.
    """
    made = stored(fingerprints(docs, width, seed, id_column, text_column), "fingerprints")
    named = made.where(F.col("id").isNotNull())
    distinct = stored(named.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    found = components(links(distinct), "simhash")
    by_fp = distinct.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component")
    )
    return (
        made.join(by_fp, "fp", "left")
        .select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
        .withColumnRenamed("id", id_column)
    )


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

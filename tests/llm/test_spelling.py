"""Spelling variants against plain Python: every pair of words is compared by its definition."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairwright.llm import spelling
from pairwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_definition(counts, ratio, near_of=None):
    near = near_of or (lambda w: [v for v in counts if one_edit(v, w)])
    found = {w: near(w) for w in counts}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(found[w]), counts.get(form.get(w))) for w, n in counts.items()}


def run(spark, rows, ratio=10, partitions=5):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(w, n, "x", 1, 2) for w, n in rows], "word string, n long, form string, word_id int, best int")
        return {tuple(r) for r in spelling.spelling_variants(df, ratio).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("seed,letters,longest,partitions", [(1, "ab", 6, 7), (2, "abcé", 5, 3), (3, "aß😀", 4, 16), (4, "abcdefgh", 3, 1)])
def test_random_words(spark, seed, letters, longest, partitions):
    rng = random.Random(seed)
    counts = {"".join(rng.choices(letters, k=rng.randint(0, longest))): rng.choice([1, 2, 3, 20, 20, 45, 400]) for _ in range(150)}
    assert run(spark, counts.items(), 2 if seed % 2 else 10, partitions) == by_definition(counts, 2 if seed % 2 else 10)


def test_chains_ties_repeats_and_nulls(spark):
    counts = {"aaaaa": 1, "aaaab": 10, "aaabb": 100, "aabbb": 1000, "xaaaaa": 10, "zzzz": 5, "zzzzz": 50, "zzzy": 50, "zzzyx": 3, "alone": 2}
    rows = [*counts.items(), ("alone", None), (None, 7), ("zzzy", 0)]
    assert run(spark, rows) == by_definition(counts, 10)


def test_very_long_words(spark):
    rng = random.Random(5)
    line = "".join(rng.choices("abc", k=30_000))
    counts = {line: 50, line[:100] + line[101:]: 5, line + "a": 4, line[:-1]: 3, "a" * 20_000: 9, "a" * 20_001: 90, line[::-1]: 1}
    assert run(spark, counts.items(), partitions=3) == by_definition(counts, 10)


def test_one_stem_in_most_words(spark):
    """Words that share a long beginning and end, over many partitions of the sorted words."""
    counts = {f"commonstem{a}{b}{c}": 1 + (len(a) * 7 + ord(b) * 11 + ord(c) * 3) % 60 for a in ("", "x", "xy") for b in "abcdefgh" for c in "abcdefgh"}
    assert run(spark, counts.items(), 3, 11) == by_definition(counts, 3)


def test_an_empty_table(spark):
    assert run(spark, []) == set()


def test_a_ratio_that_could_make_rings(spark):
    with pytest.raises(ValueError):
        run(spark, [("a", 1)], ratio=1)


def test_numbers_name_nodes(spark):
    """Two words have the same node at a depth exactly if they share the letters up to it."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(200)})
    for split in (1, 7, 64):
        numbering, nodes = spelling._Numbering(3), {}
        for begin in range(0, len(words), split):
            part = words[begin : begin + split]
            points = np.array([ord(c) for w in part for c in w], np.uint32)
            _, found = numbering.paths(points, np.array([len(w) for w in part]))
            at = 0
            for w in part:
                nodes |= {(w, d): int(found[at + d]) for d in range(len(w) + 1)}
                at += len(w) + 1
        prefix_of = {}
        for (w, d), number in nodes.items():
            assert prefix_of.setdefault(number, w[:d]) == w[:d]
        assert len(prefix_of) == len({w[:d] for w, d in nodes})


def test_the_query(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for found in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            word = "".join(c.lower() if c.isascii() else c for c in found)
            check = zlib.crc32(f"{r['doc_id']}:{word}".encode())
            if check % 31 == 0:
                k = check % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    without = {}
    for w in counts:
        for i in range(len(w)):
            without.setdefault((w[:i], w[i + 1 :]), set()).add(w)

    def near(w):
        found = set()
        for i in range(len(w) + 1):
            found |= without.get((w[:i], w[i:]), set())
            if i < len(w):
                found |= without[w[:i], w[i + 1 :]] | ({w[:i] + w[i + 1 :]} & counts.keys())
        return sorted(found - {w})

    want = by_definition(counts, 10, near)
    assert any(row[1] for row in want)
    assert {tuple(r) for r in QUERIES["op11_spelling_variants"](spark, SF).collect()} == want

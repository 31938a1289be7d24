"""Collocations against plain Python by their definition, with small tries, bitmaps and clashing ids."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pairwright.llm import collocations
from pairwright.llm.collocations import CollocationSettings, HatTrie
from pairwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "text string, lang string, gram int, n int, rank string, head int"


def by_definition(rows, s):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, s.longest + 1):
                for i in range(len(w) - size + 1):
                    counts[lang, tuple(w[i : i + size])] += 1
    often = {k: n for k, n in counts.items() if n >= s.least and len(k[1]) > 1}
    absorbed = set()
    for (lang, g), n in often.items():
        for size in range(2, len(g)):
            for i in range(len(g) - size + 1):
                if 100 * n >= s.absorb * counts[lang, g[i : i + size]]:
                    absorbed.add((lang, g[i : i + size]))
    out = {}
    for (lang, g), a in often.items():
        if (lang, g) in absorbed:
            continue
        cuts = []
        for k in range(1, len(g)):
            l, r = counts[lang, g[:k]], counts[lang, g[k:]]
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    found = set()
    for lang, held in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(held)[: s.top], 1):
            found.add((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return found


def run(spark, rows, settings):
    df = spark.createDataFrame([(t, l, 1, 2, "r", 3) for t, l in rows], SCHEMA).repartition(3)
    return {tuple(r) for r in collocations.collocations(df, settings).collect()}


def texts(seed, words, n, length):
    rng = random.Random(seed)
    alphabet = [f"w{i}" for i in range(words - 3)] + ["Straße", "ÄRGER", "x" * 50]
    weights = [1 / (i + 1) for i in range(words)]
    out = []
    for _ in range(n):
        held = rng.choices(alphabet, weights, k=rng.randint(0, length))
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\x0b"]) for w in held))
    return out


@pytest.mark.parametrize(
    "seed,settings",
    [
        (1, CollocationSettings(least=5, burst=3, held=20, top=1000, most_bits=16, bucket_bits=16)),
        (2, CollocationSettings(least=8, burst=1, held=1, top=7)),
        (3, CollocationSettings(longest=3, least=4, absorb=50)),
        (4, CollocationSettings(longest=2, least=3, bucket_bits=17)),
        (5, CollocationSettings(longest=6, least=3, absorb=80, burst=16, held=200)),
    ],
)
def test_random_texts(spark, seed, settings):
    made = texts(seed, 12, 60, 60)
    rows = [(t, ["en", "de", None][i % 3]) for i, t in enumerate(made)]
    rows += [("fixed phrase of five words, " * 4, "en"), ("a a a a a a a a a a", "en"), ("THE Same", None)] * 3
    want = by_definition(rows, settings)
    assert want and run(spark, rows, settings) == want


def test_hard_rows(spark):
    settings = CollocationSettings(least=2, bucket_bits=16)
    rows = [(None, "en"), ("", "en"), (" \t\n.", "en"), (None, None), ("one", "en"), ("one two" * 1, "en"), ("one two", "en")]
    rows += [("long text of many words " * 4000, "de"), ("x" * 200_000 + " " + "y" * 200_000, "fr")] + [("y z", "fr")] * 2
    assert run(spark, rows, settings) == by_definition(rows, settings)


def test_an_empty_table(spark):
    assert run(spark, [], CollocationSettings()) == set()


def test_clashing_ids_take_another_seed(spark, monkeypatch):
    """A first seed that is said to clash is followed by another, with the same counts."""
    asked = []

    def clash(words, least, real=collocations._clash):
        asked.append(real(words, least))
        return len(asked) == 1

    monkeypatch.setattr(collocations, "_clash", clash)
    rows = [("ab cd ef", "en")] * 4
    assert run(spark, rows, CollocationSettings(least=3)) == by_definition(rows, CollocationSettings(least=3))
    assert asked == [False, False]


def test_which_ids_clash(spark):
    schema = "lang string, word string, gram binary, n long"
    words = [("en", "ab", b"1" * 8, 5), ("de", "cd", b"1" * 8, 1), ("en", "ef", b"2" * 8, 1), ("en", "gh", b"2" * 8, 2)]
    assert collocations._clash(spark.createDataFrame(words, schema), 5)
    assert not collocations._clash(spark.createDataFrame(words, schema), 6)
    assert not collocations._clash(spark.createDataFrame(words[2:], schema), 5)
    assert collocations._clash(spark.createDataFrame([("en", "ij", bytes(8), 5)], schema), 5)


@pytest.mark.parametrize("burst,width", [(1, 2), (4, 3), (10_000, 5), (2, 5)])
def test_the_trie_counts_and_spills_sorted_subtrees(burst, width):
    rng = np.random.default_rng(burst)
    trie, want, got = HatTrie(width, burst), Counter(), Counter()
    runs = []
    for step in range(12):
        grams = rng.integers(0, 5, (200, width)).astype(np.uint64) * np.uint64(0x1111111111111111)
        want.update(map(tuple, grams.tolist()))
        trie.add(grams)
        if step % 4 == 3:
            before = len(trie)
            runs += list(trie.spill(len(trie) // 2))
            assert len(trie) <= before // 2
    held = len(trie)
    last = list(trie.spill(0))
    assert sum(len(n) for _, n in last) == held and len(trie) == 0 and list(trie.spill(0)) == []
    for ids, counts in runs + last:
        rows = list(map(tuple, ids.tolist()))
        assert rows == sorted(rows) and len(set(rows)) == len(rows) and len({r[0] for r in rows}) == 1
        for row, n in zip(rows, counts.tolist()):
            got[row] += n
    assert got == want


@pytest.mark.parametrize("least", [1, 3, 100, 127, 128, 1000])
def test_no_frequent_phrase_is_missed_by_buckets(spark, least):
    """Bytes that stop early add up to the bound wherever the true counts do, over several tasks."""
    rows = [("a b. " * least, "en"), ("c d. " * (least // 3), "en")] + [("e f g. " * (least // 4 + 1), "de")] * 4
    texts = collocations._texts(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    words = collocations.word_counts(texts, 0)
    often = collocations._frequent(words.where(f"n >= {least}"), 1, 16)
    of_pairs = collocations._Buckets(2, least, 20)
    made = collocations.stored(collocations.encode(texts, often, of_pairs, 0), "ids")
    pairs = of_pairs.frequent(made.where("chunk is not null"))
    triples = collocations.bucket_phrases(made.where("chunk is null").select("lang", "ids"), [pairs], collocations._Buckets(3, least, 20))
    ids = {r["word"]: np.frombuffer(r["gram"], np.uint64) for r in words.collect()}
    for phrase, lang, found, want in (("ab", "en", pairs, True), ("ef", "de", pairs, True), ("ba", "en", pairs, False), ("efg", "de", triples, True), ("fge", "de", triples, False)):
        line = np.concatenate([ids[w] for w in phrase])
        assert bool(found(line, np.full(len(line), collocations._lang_sum(lang)))[0]) == want


def test_ids_keep_frequent_neighbours_only(spark):
    rows = [("a b x a b c, a. b b y a", "en"), ("x y z", "en"), (None, "de"), ("a b " * 9, "fr")]
    texts = collocations._texts(spark.createDataFrame(rows, "text string, lang string").coalesce(1))
    words = collocations.word_counts(texts, 0)
    often = collocations._frequent(words.where("word in ('a', 'b', 'c')"), 1, 16)
    made = collocations.encode(texts, often, collocations._Buckets(2, 1, 16), 0).where("chunk is null").collect()
    names = {int.from_bytes(r["gram"], "little", signed=True): r["word"] for r in words.collect()} | {0: "|"}
    assert {r["lang"]: "".join(names[i] for i in r["ids"]) for r in made} == {"en": "ab|abc|bb|", "fr": "ab" * 9 + "|"}


def test_the_query_of_whole_tables(spark):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = by_definition(rows, CollocationSettings())
    assert {tuple(r) for r in QUERIES["op12_collocations"](spark, SF).collect()} == want


def test_runs_are_dealt_and_merged():
    rng = np.random.default_rng(3)
    want, runs = Counter(), []
    for _ in range(5):
        ids = np.unique(rng.integers(0, 6, (150, 3)).astype(np.uint64), axis=0)
        n = rng.integers(1, 9, len(ids))
        for row, k in zip(ids.tolist(), n.tolist()):
            want[tuple(row)] += k
        runs.append(collocations._run_rows("en", ids, n, 7))
    got, part_of = Counter(), {}
    for part in range(7):
        held = []
        for run in runs:
            for p, ids, n in zip(run.column("part").to_pylist(), run.column("ids").to_pylist(), run.column("counts").to_pylist()):
                if p == part:
                    rows = np.frombuffer(ids, np.uint64).reshape(-1, 3)
                    assert rows.tolist() == sorted(rows.tolist())
                    held.append((rows, np.frombuffer(n, np.int64)))
        if held:
            ids, n = collocations._summed(held)
            assert len(np.unique(ids, axis=0)) == len(ids) and ids.tolist() == sorted(ids.tolist())
            for row, k in zip(ids.tolist(), n.tolist()):
                assert part_of.setdefault(tuple(row), part) == part
                got[tuple(row)] += k
    assert got == want

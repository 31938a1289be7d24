"""Operators against plain Python, the libraries they stand for, or held-out rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairwright.llm import components, decontaminate, language, licences, mil, packing, pii, pitman_yor, quality_rules, simhash, token_counts
from pairwright.llm.sampling import remainder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(1)
    parts = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "1", "é", "中", "!", "<|endoftext|>", "'ve", "😀", " ", "the", "\x1c"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["'r", "x'l", "a'v"]


def test_token_counts_are_the_librarys(texts, odd):
    library = Tokenizer.from_file(PATH)
    counting = token_counts.Counter(token_counts.read_vocabulary(PATH))
    for batch in (texts, odd):
        expected = [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]
        assert counting.texts(pa.array(batch)).tolist() == expected


def test_ids_are_the_librarys(texts, odd):
    library = Tokenizer.from_file(PATH)
    encoding = packing.Encoder(token_counts.read_vocabulary(PATH))
    for batch in (texts, odd):
        ids, edges = encoding.encode(pa.array(batch), 1)
        expected = [e.ids + [1] for e in library.encode_batch(batch, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == expected


def test_fills_are_the_closest():
    rng = np.random.default_rng(0)
    for _ in range(100):
        lengths = rng.integers(1, 30, rng.integers(1, 9))
        counts = np.bincount(lengths, minlength=41)
        got = sum(size * used for size, used in packing.closest_fill(counts, 40))
        rest = sorted(lengths.tolist())
        seed = rest.pop()
        sums = {0}
        for size in rest:
            sums |= {s + size for s in sums}
        assert got == seed + max(s for s in sums if s <= 40 - seed)


def test_pieces_cover_every_id_once(documents, texts):
    rows = packing.pack(documents, PATH).collect()
    library = Tokenizer.from_file(PATH)
    ids = {i: np.array(e.ids + [1], "<u4") for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    seen = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for name, parts in seen.items():
        assert sum(n for _, n in parts) == len(ids[name]) and len({a for a, _ in parts}) == len(parts)


def test_known_pieces_and_remainders_stay_bounded(monkeypatch, spark, odd):
    content = token_counts.read_vocabulary(PATH)
    expected = packing.Encoder(content).encode(pa.array(odd), 1)
    monkeypatch.setattr(packing, "MAX_KNOWN_BYTES", 100)
    monkeypatch.setattr(token_counts, "MAX_KNOWN_BYTES", 100)
    encoding, counting = packing.Encoder(content), token_counts.Counter(content)
    for begin in range(0, len(odd), 100):
        ids, edges = encoding.encode(pa.array(odd[begin : begin + 100]), 1)
        assert ids.tolist() == expected[0][expected[1][begin] : expected[1][begin + 100 if begin + 100 < len(odd) else -1]].tolist()
        assert (counting.texts(pa.array(odd[begin : begin + 100])) + 1).tolist() == np.diff(edges).tolist()
        assert len(encoding.known) < 2000


def test_fingerprints(spark, texts):
    def plain(text):
        words = re.findall(rb"[^\x20\x09-\x0d]+", text.lower().encode() if text.isascii() else text.encode().lower())
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    held = [*texts[:60], "", "a", "A b", "a b c d"]
    df = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    got = {r["id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(held)}


@pytest.mark.parametrize("crowded", [64, 2])
def test_links_join_all_within_two_bits(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng, fps = random.Random(5), set()
    for base in [rng.getrandbits(64) for _ in range(12)]:
        for _ in range(rng.randint(1, 50)):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    got = dict(components.components(simhash.links(df), "test").collect())
    head = list(range(len(fps)))
    for _ in fps:
        for i, x in enumerate(fps):
            for j, y in enumerate(fps):
                if (x ^ y).bit_count() <= 2:
                    head[i] = min(head[i], head[j])
        if all(head[i] == head[j] for i, x in enumerate(fps) for j, y in enumerate(fps) if (x ^ y).bit_count() <= 2):
            break
    assert [got.get(i, i) for i in range(len(fps))] == head


def test_base_spans_against_the_patterns():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def plain(text):
        out = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                good = {
                    "email": True,
                    "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": 10 <= len(digits) <= 15,
                }[kind]
                if good:
                    out.append((kind, *m.span()))
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    rng = random.Random(4)
    parts = [*"ab@@..--  +1234567890()@.\n", "4111111111111111", "10.0.0.1", "a@b.c", "+1 (555) 010-0199"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 50)))
        assert pii.base_spans(text) == plain(text)


def test_field_parts_what_the_patterns_run_together(documents):
    model = pii.fit_pii(documents)
    base, spans = pii.find_spans("call +1 (884) 555-3918 63.51.224.77 now", model)
    assert [s[0] for s in base] == ["ip"] and ("phone", 5, 22) in spans
    assert pii.find_spans("in 1984 we sold 12,000 of them at 3.50", model)[1] == []


def test_field_decodes_the_best_cut(monkeypatch):
    rng = random.Random(6)
    model = pii.SemiMarkov(np.random.default_rng(3).normal(0, 1, (pii.N_FEATURES, 4)))
    for _ in range(200):
        region = "".join(rng.choices([*"1+.@-( a\u00b2", "10.0.0.1"], k=rng.randint(1, 30))).strip() or "1"
        held = pii.Lattice.of(region)
        scores = (held.x @ model.weights).max(axis=1)
        n = len(held.ends) - 1
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = max([best[j - 1], *(best[i] + scores[k] for k, (i, e) in enumerate(held.pairs) if e == j)])
        for at_once in (512, 3):
            monkeypatch.setattr(pii, "ATOMS_AT_ONCE", at_once)
            place = {end: i for i, end in enumerate(held.ends)}
            found = [(place[a], place[b]) for _, a, b in model.decode(region)]
            assert all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
            assert abs(sum(scores[held.pairs.index(s)] for s in found) - best[n]) < 1e-9


def test_field_gradient_is_that_of_the_likelihood():
    held = pii.Lattice.of("+1 (555) 010")
    gold = {(0, 2, 3)}
    model = pii.SemiMarkov(np.random.default_rng(0).normal(0, 0.5, (pii.N_FEATURES, 4)))

    def likelihood(weights):
        scores = held.x @ weights
        n = len(held.ends) - 1
        total = np.zeros(n + 1)
        for j in range(1, n + 1):
            ways = [total[j - 1]] + [total[i] + np.logaddexp.reduce(scores[k]) for k, (i, e) in enumerate(held.pairs) if e == j]
            total[j] = np.logaddexp.reduce(ways)
        return sum(scores[held.pairs.index((i, j)), t] for i, j, t in gold) - total[n]

    got = model.gradient(held, gold)
    for f, t in ((0, 3), (4, 0), (9, 3)):
        step = np.zeros_like(model.weights)
        step[f, t] = 1e-5
        assert abs((likelihood(model.weights + step) - likelihood(model.weights - step)) / 2e-5 - got[f, t]) < 1e-5


@pytest.mark.parametrize("width", [1, 2, 3, 7, 10])
def test_passages_are_all_occurrences_of_windows(width):
    rng = random.Random(width)

    def plain(items, text):
        words, hit, names = text.lower().split(), set(), set()
        for name, item in items:
            own = item.lower().split()
            size = min(width, len(own))
            runs = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in runs:
                    hit |= set(range(i, i + size))
                    names.add(name)
        return sorted(hit), sorted(names)

    for _ in range(300):
        kinds = "abc"[: rng.randint(1, 3)]
        items = tuple((str(i), " ".join(rng.choices(kinds, k=rng.randint(0, 3 * width)))) for i in range(rng.randint(0, 5)))
        text = " ".join(rng.choices(kinds.upper() + "z", k=rng.randint(0, 30)) + [t for _, t in items[:2]])
        found = decontaminate._found(decontaminate.Passages(items, width), text)
        assert (found["hits"], found["items"]) == plain(items, text)


def test_blocks_of_a_benchmark_give_what_one_gives(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = decontaminate.scan_documents(documents, items).select("doc_id", "passages")
    parts = decontaminate.scan_documents(documents, items, block_bytes=3000).select("doc_id", "passages")
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    row = whole.where("size(passages.hits) > 0").join(documents.select("doc_id", "text"), "doc_id").first()
    span = row["passages"]["spans"][0]
    words = re.findall(r"[^\W_]+", row["text"][span["start"] : span["stop"]])
    assert len(words) >= 1


def test_notices_are_found_inside_texts(spark):
    rows = [(1, "Some prose. Released under the MIT License. More."), (2, "This work is licensed under the GNU General Public License, version 3."),
            (3, "released from the old license office"), (4, "licensed under the  apache license VERSION 2.0")]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: [l["licence"] for l in r["licences"]] for r in got.collect()} == {1: ["MIT"], 2: ["GPL-3.0"], 3: [], 4: ["Apache-2.0"]}


def test_measures_against_plain_python(spark, texts):
    held = [*texts, "a b c a b c", "x " * 500, "\n".join(f"w{i} v{i} u{i} t{i}" for i in list(range(100)) * 2)]
    df = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = list(zip(words, words[1:], words[2:]))
        covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)} if len(runs) < 2000 else None
        lines = [l for l in text.split("\n") if l.strip(" \t\n\x0b\x0c\r")]
        return len(words), sum(map(len, words)), len(lines) - len(set(lines)), None if covered is None else len(covered)

    for r in quality_rules.ledger(df).collect():
        n, chars, lines, covered = plain(held[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (n, chars, lines)
        assert covered is None or r["n_repeat_words"] == covered


def test_ablations_count_what_a_rule_alone_drops(documents):
    chosen = quality_rules.policy("web", 2)
    entries = quality_rules.ledger(documents).cache()
    kept = entries.where(~quality_rules.fails(chosen)).count()
    for r in quality_rules.ablations(entries, chosen).collect():
        rest = quality_rules.Policy("t", 1, tuple(n for n in chosen.rules if n != r["rule"]))
        assert r["kept"] == kept and r["kept_without"] == entries.where(~quality_rules.fails(rest)).count()


def test_language_of_held_out_rows(documents):
    held = remainder("doc_id", 4) == 2
    model = language.fit_language(documents.where(~held))
    got = language.identify(documents.where(held), model).select((F.col("language.pred") == F.col("lang")).cast("int").alias("ok"))
    assert got.agg(F.avg("ok")).first()[0] > 0.95


def test_quality_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = remainder("doc_id", 5) == 0
    model = mil.fit_quality(docs, labels.where(~held))
    got = mil.score_quality(docs.where(held), model).join(labels, "doc_id")
    ok = ((F.col("quality_score") >= 0.3).cast("int") == F.col("quality")).cast("int")
    assert got.agg(F.avg(ok)).first()[0] > 0.95


def test_seating_keeps_its_customers():
    rng = np.random.default_rng(1)
    settings = pitman_yor.PitmanYorSettings()
    restaurant = np.repeat(np.arange(20), 5)
    customers = rng.integers(0, 40, 100)
    parent = np.full(100, 0.2)
    tables = [np.array([c]) if c else np.array([], np.int64) for c in customers]
    for _ in range(5):
        sizes, number, p = pitman_yor.sample_seating(restaurant, customers, tables, parent, settings, rng)
        edges = np.concatenate([[0], np.cumsum(number)])
        tables = [sizes[a:b] for a, b in zip(edges, edges[1:])]
        assert [int(t.sum()) for t in tables] == customers.tolist()
        assert np.allclose(np.bincount(restaurant, p), 1)  # the parent's probabilities sum to one


def test_seating_moves_all_customers_of_a_dish():
    """Numbers of tables follow their law, by the recursion of Stirling numbers, for a few customers and for many."""
    settings = pitman_yor.PitmanYorSettings()
    d, theta = settings.discount, settings.strength
    for customers, others, parent, sweeps, copies in ((6, 20, 0.05, 20, 8000), (100, 300, 0.05, 60, 500)):
        ways = np.eye(1, customers + 1)[0]
        for n in range(customers):
            ways = ways * (n - d * np.arange(customers + 1)) + np.append(0, ways[:-1])
        weight = ways * np.cumprod(np.append(1, (theta + d * (others + np.arange(customers))) * parent))
        law = weight / weight.sum()
        mean = (law * np.arange(customers + 1)).sum()
        rng = np.random.default_rng(3)
        held = (np.ones(copies, np.int64), np.full(copies, customers))
        for _ in range(sweeps):
            whole = (others + held[0], np.full(copies, 1000))
            sizes, number, _ = pitman_yor.sample_seating(
                np.arange(copies), np.full(copies, customers), held, np.full(copies, parent), settings, rng, whole
            )
            held = (number, sizes)
        assert abs(held[0].mean() - mean) < 0.05 * mean
    # A frequent dish gets its tables in a sweep, not a handful of moves.
    many = np.array([100_000])
    sizes, number, _ = pitman_yor.sample_seating(np.zeros(1, np.int64), many, [many], np.full(1, 0.05), settings, rng, (np.array([5000]), many))
    assert number[0] > 50 and sizes.sum() == 100_000 and len(sizes) == number[0]


def test_counts_of_slices_are_added_up():
    batches = [pa.RecordBatch.from_pydict({"word": [str(i % m) for i in range(40)], "n": list(range(40))}) for m in (7, 40, 3)]
    for rows, size in ((1, 1 << 20), (50, 1 << 20), (1 << 18, 1)):
        got = {}
        for batch in pitman_yor._added_up(iter(batches), ["word"], rows, size):
            for r in batch.to_pylist():
                got[r["word"]] = got.get(r["word"], 0) + r["n"]
        assert got == {str(k): sum(i for m in (7, 40, 3) for i in range(40) if i % m == k) for k in range(40)}


def test_scores_beat_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), "text", (remainder("doc_id", 10) != 0).alias("train"))
    scored = pitman_yor.score_texts(rows).cache()
    held = scored.where("not train").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1]
    base = duckdb.sql(
        r"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) w from '/root/testdata/sf0.01/documents.parquet')
        select count(*) from t"""
    ).fetchall()[0][0]
    assert scored.agg(F.sum("n_tokens")).first()[0] == base + docs.count()


@pytest.mark.parametrize("held_words", [1 << 18, 0])
def test_words_too_long_for_a_double_keep_their_probability(spark, held_words):
    words = {"long": "ab" * 500, "short": "ab" * 20}
    rows = [(i, t, True) for i, t in enumerate(["the cat sat on the mat", "the abba sat", "a cab at a bar"] * 5)]
    rows += [(name, f"the {w}", False) for name, w in words.items()]
    rows = [(str(i), t, train) for i, t, train in rows]
    df = spark.createDataFrame(rows, "id string, text string, train boolean")
    settings = pitman_yor.PitmanYorSettings(order=2, markers=4, classes=2, held_words=held_words)
    counts = pitman_yor.word_counts(df, pitman_yor.find_contexts(df, settings))
    lp = {r["gram"]: r["lp"] for r in pitman_yor.gram_probabilities(counts, settings).collect()}
    spelling = {name: sum(lp[g] for g in pitman_yor.word_grams(w, 2)) for name, w in words.items()}
    assert 10.0 ** spelling["long"] == 0
    got = {r["id"]: r["score"] for r in pitman_yor.score_texts(df, settings).collect()}
    # Unseen words of one context differ in their spelling alone.
    assert got["long"] - got["short"] == pytest.approx(spelling["long"] - spelling["short"], abs=1e-6)
    assert got["long"] < spelling["long"]


def test_pitman_yor_grams_are_ranges_of_bytes():
    words = ["", "a", "abcdef", "aaaaaaa", "é", "日本語テキスト", "a😀b😀c", "x" * 40]
    owner, codes, grams = pitman_yor.coded_grams(pa.array(words), 4)
    names = [g.decode() for g in grams.to_pylist()]
    assert len(set(names)) == len(names)
    found = [[names[c] for c, o in zip(codes, owner) if o == i] for i in range(len(words))]
    assert found == [pitman_yor.word_grams(w, 4) for w in words]
    assert not len(pitman_yor.coded_grams(pa.array([], pa.string()), 4)[1])


def test_words_are_found_from_either_side():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 9), (9, 0), (30, 400), (400, 30), (50, 50)):
        words, among = ([str(x).encode() for x in rng.permutation(500)[:k]] for k in (n, m))
        got = pitman_yor._places(pa.array(words, pa.large_binary()), pa.array(among, pa.large_binary()))
        assert got.dtype == np.int64 and got.tolist() == [among.index(w) if w in among else -1 for w in words]


def test_word_counts_travel_once(spark, monkeypatch):
    """Counts of all classes of a word are one row and one exchange; classes of held-out texts alone have a dish of none."""
    texts = ["a b A c", "b b", None, "", " ", "c a x", "x", "y a y"] * 5
    rows = [(i, t, i % 8 < 6) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, train boolean").repartition(3)
    monkeypatch.setattr(pitman_yor, "SLICE", 6)
    contexts = pitman_yor.Contexts({b"a": 1, b"b": 2}, 4)
    counts = pitman_yor.word_counts(df, contexts)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    expected = {}
    for _, text, train in rows:
        last = 0
        for word in [*(text or "").lower().split(), ""]:
            dish = expected.setdefault(word, {}).setdefault(last, [0, 0])
            dish[0] += train
            dish[1] += 1
            last = {"a": 1, "b": 2}.get(word, last)
    got = {r["word"]: r for r in counts.collect()}
    assert got.keys() == expected.keys()
    for word, dishes in expected.items():
        assert [(d["cls"], d["c"]) for d in got[word]["dishes"]] == [(c, dishes[c][0]) for c in sorted(dishes)]
        assert (got[word]["train"], got[word]["total"]) == tuple(map(sum, zip(*dishes.values())))


@pytest.mark.parametrize("rare", [3, 8, 40, 1 << 15])
def test_pitman_yor_frequent_words_are_exact(spark, monkeypatch, rare):
    """Words that are rare in a slice are not counted there; the most frequent ones are those of all counts, in order."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[i % 2]}{min(9, int(w))}" for w in rng.geometric(0.4, 60)) for i in range(60)]
    texts += ["late " * 30, " ".join(f"r{i}" for i in range(200)), None, ""]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "id long, text string, train boolean").repartition(5)
    monkeypatch.setattr(pitman_yor, "RARE", rare)
    monkeypatch.setattr(pitman_yor, "SLICE", 500)
    counts = Counter(w for t in texts if t for w in t.split())
    expected = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    for most in (1, 4, 11, 300):
        assert pitman_yor._frequent_words(df, most) == expected[:most]
    given = pitman_yor._plain_counts(df, 8).where("word != ''").count()
    assert given < len(counts) / 4

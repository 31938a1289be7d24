"""Tokens against the ``tiktoken`` library, fed with the same small merge table."""

import base64
import random

import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from pairwright.functions.bpe import merge_word
from pairwright.operators import tokens
from pairwright.operators.tokens import detokenize, token_texts, tokenize
from pairwright.sources.vocabulary import GPT2_PATTERN, get_vocabulary

END = "<|endoftext|>"
MERGES = [" t", "he", " the", "in", "er", " a", "on", "an", "re", " s", "  ", "é", "ab", "aba", "→", "\n\n", "12"]
TEXTS = [
    "",
    "Question → SPARQL:\nQuestion: the thin banana, isn't it?\nSPARQL: ENTITY_0012 12123",
    "  leading and   inner  spaces \n\n trailing   ",
    "élan vital é ₂ ½ 漢字 😀 naïve 　x",
    "ababababa aaaa" + "ab" * 3000,
    "don't we'll they've I'd 'S",
    "!?!?…—  \t\t\r\n",
    "nul\u0000and\u001ccontrol",
]


@pytest.fixture(scope="module")
def ranks():
    table = {bytes([b]): b for b in range(256)}
    for merge in MERGES:
        raw = merge.encode()
        for end in range(2, len(raw) + 1):
            table.setdefault(raw[:end], len(table))
    return table


@pytest.fixture(scope="module")
def vocabulary(spark, ranks, tmp_path_factory):
    path = tmp_path_factory.mktemp("vocabulary") / "small.txt"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in ranks.items()))
    return get_vocabulary(spark, "gpt2", str(path))


@pytest.fixture(scope="module")
def library(ranks):
    pattern = GPT2_PATTERN.removeprefix("(?U)")
    return tiktoken.Encoding("small", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END: 50256})


def corpus(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, org_text string")


def test_ids_and_texts(spark, vocabulary, library):
    got = tokenize(corpus(spark, [*TEXTS, None]), vocabulary).orderBy("id").collect()
    for row, text in zip(got, TEXTS):
        ids = library.encode(text)
        assert row["encoded_text"] == ids
        assert row["decoded_text"] == [library.decode([i]) for i in ids]
    assert got[-1]["encoded_text"] is None


def test_words_of_a_batch_are_encoded_in_bounded_slices(spark, vocabulary, library, monkeypatch):
    lists = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"], ["d"] * 4], pa.list_(pa.string()))
    for most in (1, 4, 100):
        parts = list(tokens.word_slices(lists, most))
        assert pa.concat_arrays(parts).equals(lists)
        assert all(len(p) == 1 or len(p.flatten()) <= most for p in parts)
    assert len(list(tokens.word_slices(lists[:0], 4))) == 1
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 5)
    got = tokenize(corpus(spark, [*TEXTS, None] * 3).coalesce(1), vocabulary).orderBy("id").collect()
    assert [r["encoded_text"] for r in got] == [None if t is None else library.encode(t) for t in [*TEXTS, None] * 3]


def test_special_token(spark, vocabulary, library):
    rows = [f"a the{END}{END} b  {END}", END, f"!{END}!", "plain"]
    df = corpus(spark, rows)
    allowed = tokenize(df, vocabulary, on_special="allow").orderBy("id").collect()
    assert [r["encoded_text"] for r in allowed] == [library.encode(t, allowed_special={END}) for t in rows]
    assert allowed[1]["decoded_text"] == [END]
    plain = tokenize(df, vocabulary, on_special="text", texts=False).orderBy("id").collect()
    assert [r["encoded_text"] for r in plain] == [library.encode(t, disallowed_special=()) for t in rows]
    with pytest.raises(Exception, match="special token"):
        tokenize(df, vocabulary, on_special="error").collect()
    with pytest.raises(ValueError):
        tokenize(df, vocabulary, on_special="maybe")


def test_decoding(spark, vocabulary, library):
    rng = random.Random(1)
    rows = [library.encode(t) for t in TEXTS] + [[rng.randrange(270) for _ in range(30)] for _ in range(50)]
    rows += [[], [50256, 65], [195], [226, 134]]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, encoded_text array<int>")
    read = detokenize(token_texts(df, vocabulary), vocabulary).orderBy("id").collect()
    for row, ids in zip(read, rows):
        assert row["text"] == library.decode(ids)
        assert row["decoded_text"] == [library.decode([i]) for i in ids]
    with pytest.raises(Exception, match="no token with id 9999"):
        detokenize(spark.createDataFrame([([9999],)], "encoded_text array<int>"), vocabulary).collect()


def test_merging_is_the_library_s(ranks, library):
    rng = random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choices(["a", "b", "h", "e", "t", " ", "r", "é", "n", "1", "2"], k=rng.randint(1, 14)))
        assert merge_word(word.encode(), ranks) == library._encode_single_piece(word.encode())


def test_tokens_are_made_where_the_rows_are(spark, vocabulary, plan_of):
    made = tokenize(corpus(spark, TEXTS), vocabulary)
    main = plan_of(made.where(F.size("encoded_text") > 1)).split("Subquery")
    assert "Exchange" not in main[0] and "BatchEvalPython" not in plan_of(made)


def test_decoding_holds_the_table_outside_the_rows(spark, vocabulary, plan_of):
    df = spark.createDataFrame([(1, [65, 66])], "id long, encoded_text array<int>")
    read = detokenize(token_texts(df, vocabulary), vocabulary)
    assert "_slots" not in plan_of(read) and "Exchange" not in plan_of(read).split("Subquery")[0]


def test_unknown_vocabulary_is_an_error(spark):
    with pytest.raises(KeyError):
        get_vocabulary(spark, "gpt9")
    with pytest.raises(ValueError):
        get_vocabulary(spark, "gpt2")

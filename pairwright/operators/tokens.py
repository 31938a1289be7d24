"""Text to token ids and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.bpe import merge_word
from pairwright.operators.lookup import values_by_number
from pairwright.sources.vocabulary import Vocabulary

#: Words whose codes a task keeps; beyond it, it begins anew.
KNOWN_WORDS = 200_000
#: Words that are encoded at a time, or one row if that has more.
WORDS_AT_ONCE = 1 << 17


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def split_words(text: Column, vocabulary: Vocabulary, on_special: str = "error") -> Column:
    """The words that are encoded one by one; together they are the whole text.

    A special token in the text is an error, ordinary text (``text``), or a special token
    (``allow``), which shows as a null word.
    """

    def words(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(vocabulary.pattern), F.lit(0))

    (special,) = vocabulary.special
    if on_special == "text":
        return words(text)
    if on_special == "error":
        message = F.lit(f"text holds the special token {special}")
        checked = F.when(F.contains(text, F.lit(special)), F.raise_error(message).cast("string"))
        return words(checked.otherwise(text))
    if on_special == "allow":
        cut = F.split(text, _quoted(special), -1)
        led = F.transform(
            cut,
            lambda part, i: F.when(i == 0, words(part)).otherwise(
                F.concat(F.array(F.lit(None).cast("string")), words(part))
            ),
        )
        return F.flatten(led)
    raise ValueError(f"on_special is error, text or allow, not {on_special!r}")


def _code_type(texts: bool) -> str:
    return "struct<ids:array<int>,texts:array<string>>" if texts else "array<int>"


def _encoder(
    spark: SparkSession, vocabulary: Vocabulary, texts: bool
) -> Callable[[pa.Array], pa.Array]:
    """A function from an Arrow array of words to their codes; a null word has a null code.

    A code is the ids of a word or, with ``texts``, a struct of the ids and the text of each.
    The merge ranks come by broadcast, and each distinct word of a batch is looked up once.
    """
    held = spark.sparkContext.broadcast(vocabulary.merge_ranks())
    shown: dict[int, str] = {}
    known: dict[str, list[int]] = {}

    def encode(words: pa.Array) -> pa.Array:
        ranks = held.value
        if texts and not shown:
            shown.update((i, t.decode("utf-8", "replace")) for t, i in ranks.items())
        distinct = words.dictionary_encode()
        if len(known) > KNOWN_WORDS:
            known.clear()
        ids = []
        for word in distinct.dictionary.to_pylist():
            code = known.get(word)
            if code is None:
                code = known[word] = merge_word(word.encode("utf-8"), ranks)
            ids.append(code)
        codes = pa.array(ids, pa.list_(pa.int32()))
        if texts:
            spelled = pa.array([[shown[i] for i in w] for w in ids], pa.list_(pa.string()))
            codes = pa.StructArray.from_arrays([codes, spelled], ["ids", "texts"])
        return codes.take(distinct.indices)

    return encode


def word_slices(lists: pa.Array, most: int) -> Iterator[pa.Array]:
    """Cut an array of lists where its elements pass ``most``; every slice has a row, an empty array is one slice."""
    ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends) or not len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lists.slice(start, stop - start)
        if not len(ends):
            return
        start = stop


def tokenize(
    df: DataFrame,
    vocabulary: Vocabulary,
    text: str = "org_text",
    on_special: str = "error",
    texts: bool = True,
) -> DataFrame:
    """Add ``encoded_text`` (ids) and, with ``texts``, ``decoded_text`` (the text of each id).

    One pass: words are split by expressions and encoded in slices of Arrow batches where they stand, each
    distinct word of a slice once, with the codes of words met before kept by the task. What a task
    holds of codes is a slice's, however many rows Spark puts into a batch.
    """
    ((special, special_id),) = vocabulary.special.items()
    encode = _encoder(df.sparkSession, vocabulary, texts)

    def encode_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for words in word_slices(batch, WORDS_AT_ONCE):
                lengths = pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False)
                ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
                yield pa.ListArray.from_arrays(ends, encode(words.flatten()))
            pa.default_memory_pool().release_unused()

    # Not marked deterministic, so that no filter on its result runs it a second time.
    run = F.arrow_udf(encode_lists, f"array<{_code_type(texts)}>").asNondeterministic()
    mark = F.array(F.lit(special_id))
    if texts:
        mark = F.struct(mark.alias("ids"), F.array(F.lit(special)).alias("texts"))
    words = split_words(F.col(text), vocabulary, on_special)
    coded = df.withColumn("_words", words).withColumn("_coded", run("_words"))
    codes = F.col("_coded")
    if on_special == "allow":
        codes = F.transform("_coded", lambda code: F.coalesce(code, mark))
    made = coded.select(*df.columns, F.when(F.col("_words").isNotNull(), codes).alias("_codes"))
    if not texts:
        return made.select(*df.columns, F.flatten("_codes").alias("encoded_text"))
    return made.select(
        *df.columns,
        F.flatten("_codes.ids").alias("encoded_text"),
        F.flatten("_codes.texts").alias("decoded_text"),
    )


def _pieces(df: DataFrame, vocabulary: Vocabulary, ids: str, piece: str) -> DataFrame:
    kept = df.withColumn("_ids", F.col(ids))
    pieces = vocabulary.pieces().select(F.col("id").alias("key"), F.col(piece).alias("value"))
    return values_by_number(kept, "_ids", pieces, vocabulary.checked_size(), "_pieces", "no token with id ")


def token_texts(
    df: DataFrame, vocabulary: Vocabulary, ids: str = "encoded_text", out: str = "decoded_text"
) -> DataFrame:
    """Add the text of every id on its own; bytes that are no whole character show as U+FFFD."""
    found = _pieces(df, vocabulary, ids, "text")
    return found.select(*df.columns, F.col("_pieces").alias(out))


def detokenize(
    df: DataFrame, vocabulary: Vocabulary, ids: str = "encoded_text", out: str = "text"
) -> DataFrame:
    """Add the text of an id sequence: bytes are joined first and decoded once."""
    found = _pieces(df, vocabulary, ids, "hex")
    joined = F.unhex(F.array_join("_pieces", ""))
    return found.select(*df.columns, F.make_valid_utf8(joined.cast("string")).alias(out))

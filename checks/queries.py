"""One Spark query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.pairs_view import PAIRS_SQL
from pairwright.config import Settings
from pairwright.functions.arrays import argmax, keep_last, softmax
from pairwright.functions.ids import extract_eids, extract_labels
from pairwright.functions.prompt import render_prompt
from pairwright.operators.batches import (
    batch_count,
    batch_of,
    batch_stats,
    collate,
    collate_stored,
    collate_with,
    export_batches,
    load_batches,
)
from pairwright.operators.dictionary import all_queries, build_dictionary
from pairwright.operators.follow import follow_table
from pairwright.operators.generate import TableWalker, greedy_decode, next_token_table, table_scorer
from pairwright.operators.grown_dictionary import grow_dictionary, read_grown
from pairwright.operators.index import contiguous_index
from pairwright.operators.loss import (
    batch_losses,
    checkpoint_losses,
    mean_of_batches,
    next_choice,
    sharded_batch_losses,
    sliced_model_batch_losses,
)
from pairwright.operators.preview import batch_numbers, first_rows, observe_rows, record_at, shape
from pairwright.operators.rewrite import decode_labels, encode_ids
from pairwright.operators.split import exact_split, split_at
from pairwright.operators.tokens import detokenize, token_texts, tokenize
from pairwright.plans.evaluate import model_inputs, model_loss, stored_loss
from pairwright.plans.infer import answer
from pairwright.plans.prepare import token_records
from pairwright.sources.batch_sink import read_batches, write_batches
from pairwright.sources.batch_table import read_record, read_token_batches, write_token_batches
from pairwright.sources.csv_blocks import read_csv_blocks
from pairwright.sources.dictionary_files import read_dictionary, write_dictionary
from pairwright.sources.pairs import literal_pairs, read_csv, read_raw_pairs, rename_pairs, write_csv
from pairwright.sources.tables import spread
from pairwright.sources.token_table import read_tokens, write_tokens
from pairwright.sources.vocabulary import Vocabulary, byte_vocabulary, get_vocabulary, write_ranked
from pairwright.workspace import fresh_path, materialize

SETTINGS = Settings()
WINDOW = 64
GREEDY_WINDOW = 96
#: Merged runs of two bytes and of three bytes in the vocabulary made of documents.
MERGES = 150
BYTES_AND_PAD = 257


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows mean much work each, over all cores even if it is one small file."""
    return spread(table(spark, sf_dir, name))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = PAIRS_SQL.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=texts(spark, sf_dir, "orders"))


def part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pairs(spark, sf_dir).where(F.col("part") == name)


def corpus_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = all_queries(part(spark, sf_dir, "train"), part(spark, sf_dir, "test"))
    return build_dictionary(queries)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_ids(rename_pairs(pairs(spark, sf_dir)), corpus_dictionary(spark, sf_dir), row_key=["row_id"])


def joined(values: Column, mark: str = " ") -> Column:
    return F.array_join(values.cast("array<string>"), mark)


# Pairs: projections, union, ids, dictionary, rewrite, split, prompts.


def q_rename_pairs(spark, sf_dir):
    return rename_pairs(pairs(spark, sf_dir))


def q_union_sparql(spark, sf_dir):
    return all_queries(part(spark, sf_dir, "train"), part(spark, sf_dir, "test"))


def q_extract_ids(spark, sf_dir):
    ids = extract_eids(F.col("sparql_wikidata"))
    found = pairs(spark, sf_dir).select("row_id", F.posexplode_outer(ids).alias("place", "eid"))
    return found.where(F.col("eid").isNotNull())


def q_dictionary(spark, sf_dir):
    path = fresh_path(spark, "dictionary")
    write_dictionary(corpus_dictionary(spark, sf_dir), path)
    return read_dictionary(spark, path).select("eid", "label")


def q_dictionary_inverse(spark, sf_dir):
    return q_dictionary(spark, sf_dir).select("label", "eid")


def q_dictionary_grown(spark, sf_dir):
    """Train queries, then test queries, these once more as a repeated batch, and nothing new."""
    path = fresh_path(spark, "grown")
    for version, name in ((0, "train"), (1, "test"), (1, "test"), (2, "train")):
        grow_dictionary(spark, path, part(spark, sf_dir, name), version)
    return read_grown(spark, path).select("eid", "label", "version")


def q_encode_ids(spark, sf_dir):
    return encoded(spark, sf_dir)


def q_extract_labels(spark, sf_dir):
    labels = extract_labels(F.col("sparql_modf"))
    found = encoded(spark, sf_dir).select("row_id", F.posexplode_outer(labels).alias("place", "label"))
    return found.where(F.col("label").isNotNull())


def q_decode_labels(spark, sf_dir):
    dictionary = corpus_dictionary(spark, sf_dir)
    coded = materialize(encode_ids(rename_pairs(pairs(spark, sf_dir)), dictionary, row_key=["row_id"]), "encoded")
    return decode_labels(coded, dictionary, row_key=["row_id"]).select("row_id", "decoded_sparql")


def q_encode_joined(spark, sf_dir):
    rows = rename_pairs(pairs(spark, sf_dir))
    return encode_ids(rows, corpus_dictionary(spark, sf_dir), broadcast_bytes=0).select("row_id", "question", "sparql", "sparql_modf")


def q_decode_joined(spark, sf_dir):
    dictionary = corpus_dictionary(spark, sf_dir)
    coded = encode_ids(rename_pairs(pairs(spark, sf_dir)), dictionary, row_key=["row_id"])
    return decode_labels(coded, dictionary, broadcast_bytes=0).select("row_id", "decoded_sparql")


def _split(spark, sf_dir):
    return exact_split(part(spark, sf_dir, "train"), "row_id", SETTINGS.valid_fraction, SETTINGS.split_seed)


def q_split_train(spark, sf_dir):
    return rename_pairs(_split(spark, sf_dir)[0])


def q_split_valid(spark, sf_dir):
    return rename_pairs(_split(spark, sf_dir)[1])


def q_split_parts(spark, sf_dir):
    """Three parts of all pairs by two cuts, found digit by digit down to forty rows."""
    parts = split_at(rename_pairs(pairs(spark, sf_dir)), [0.25, 0.125], "row_id", SETTINGS.split_seed, small=40)
    named = [p.select("row_id", F.lit(i).alias("place")) for i, p in enumerate(parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def q_observed_counts(spark, sf_dir):
    """Rows and batches of each part, counted in the pass that writes the pairs."""
    rows, counted = observe_rows(pairs(spark, sf_dir), ["train", "test"], "part")
    rows.write.parquet(fresh_path(spark, "pairs"))
    found = counted.get
    batches = batch_numbers(found, SETTINGS.batch_sizes)
    return spark.createDataFrame([(p, n, batches[p]) for p, n in found.items()], "part string, n_rows long, n_batches long")


def q_prompt_train(spark, sf_dir):
    prompt = render_prompt("train", F.col("question"), F.col("sparql_modf"))
    return encoded(spark, sf_dir).select("row_id", prompt.alias("org_text"))


def q_prompt_test(spark, sf_dir):
    prompt = render_prompt("test", F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("org_text"))


def q_preview(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    first = [first_rows(part(spark, sf_dir, p), ["row_id"]) for p in ("train", "test")]
    sizes = shape(rows, ["part"])
    return first[0].unionByName(first[1]).join(sizes, "part")


def q_csv_roundtrip(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "csv")
    write_csv(documents, path)
    return read_csv(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


def q_csv_multiline(spark, sf_dir):
    """Documents with more quotes, commas and line breaks, read by blocks and numbered by file and place."""
    odd = F.concat(F.lit('"'), "text", F.lit('",\r\n""'), "lang", F.lit('"\n'))
    rows = table(spark, sf_dir, "documents").select("doc_id", odd.alias("text"), "source")
    path = fresh_path(spark, "csv")
    write_csv(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    return read_csv_blocks(spark, path, "doc_id long, text string, source string", row_id="row_id")


def q_csv_numbered(spark, sf_dir):
    """Pairs written in order to several files, read back and numbered by file and place."""
    path = fresh_path(spark, "csv")
    write_csv(pairs(spark, sf_dir).drop("part").repartitionByRange("row_id").sortWithinPartitions("row_id"), path)
    return rename_pairs(read_raw_pairs(spark, path, multiline=False))


def q_literal_rows(spark, sf_dir):
    """Rows written out here, each with the number of orders it asks for."""
    asked = literal_pairs(spark, [("1-URGENT", "ASK { ex:K1 }"), ("5-LOW", "ASK { ex:K2 }"), ("none", "")])
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"))
    found = asked.join(counts, F.col("question") == F.col("o_orderpriority"), "left")
    return found.select("row_id", render_prompt("test", F.col("question")).alias("org_text"), "org_sparql", "n_orders")


# Tokens.


def _documents(spark, sf_dir, **options):
    vocabulary = get_vocabulary(spark, "bytes")
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("org_text"))
    return vocabulary, tokenize(rows, vocabulary, **options)


def q_tokenize(spark, sf_dir):
    _, tokens = _documents(spark, sf_dir, texts=False)
    ids = F.col("encoded_text")
    return tokens.select("doc_id", "org_text", joined(ids).alias("encoded_text"), F.size(ids).alias("n_tokens"))


def q_token_texts(spark, sf_dir):
    vocabulary, tokens = _documents(spark, sf_dir, texts=False)
    read = token_texts(tokens, vocabulary)
    return read.select("doc_id", joined(F.col("decoded_text"), "|").alias("decoded_text"))


def q_tokenize_special(spark, sf_dir):
    vocabulary = get_vocabulary(spark, "bytes")
    marked = F.concat_ws("<|endoftext|>", "role", "text", F.lit(""))
    rows = texts(spark, sf_dir, "conversations").select("conv_id", "turn", marked.alias("org_text"))
    tokens = tokenize(rows, vocabulary, on_special="allow", texts=False)
    return tokens.select("conv_id", "turn", joined(F.col("encoded_text")).alias("encoded_text"))


def q_detokenize(spark, sf_dir):
    vocabulary, tokens = _documents(spark, sf_dir, texts=False)
    return detokenize(tokens, vocabulary).select("doc_id", "text")


def _merged(spark: SparkSession, sf_dir: str) -> tuple[Vocabulary, DataFrame]:
    """Whole documents, and a vocabulary of their most frequent runs of two and of three bytes inside
    words, white space among them."""
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("org_text"))
    word = F.explode(F.regexp_extract_all("org_text", F.lit(get_vocabulary(spark, "bytes").pattern), F.lit(0)))
    words = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    spelled = words.select(F.hex(F.encode("word", "utf-8")).alias("h"), "uses")
    frames = []
    for size, begin in ((2, 256), (3, 256 + MERGES)):
        place = F.explode(F.when(F.length("h") >= 2 * size, F.sequence(F.lit(1), F.length("h") - 2 * size + 1, F.lit(2))))
        runs = spelled.select("h", "uses", place.alias("i")).select(F.expr(f"substr(h, i, {2 * size})").alias("run"), "uses")
        most = runs.groupBy("run").agg(F.sum("uses").alias("uses")).orderBy(F.desc("uses"), "run").limit(MERGES)
        ranked = most.withColumn("id", F.row_number().over(Window.orderBy(F.desc("uses"), "run")) + F.lit(begin - 1))
        frames.append(ranked.select("id", F.unhex("run").alias("token")))
    path = fresh_path(spark, "vocabulary")
    write_ranked(byte_vocabulary(spark).frame.unionByName(frames[0]).unionByName(frames[1]), path)
    return get_vocabulary(spark, "gpt2", path), rows


def q_tokenize_merged(spark, sf_dir):
    vocabulary, rows = _merged(spark, sf_dir)
    tokens = tokenize(rows, vocabulary, texts=False)
    return tokens.select("doc_id", joined(F.col("encoded_text")).alias("encoded_text"))


def q_detokenize_merged(spark, sf_dir):
    vocabulary, rows = _merged(spark, sf_dir)
    tokens = tokenize(rows, vocabulary, texts=False)
    return detokenize(tokens, vocabulary).select("doc_id", "text")


def _token_table(spark: SparkSession, sf_dir: str) -> str:
    """Prompts of all pairs as a token table, a split to a folder."""
    split = F.when(F.col("part") == "test", "test").when(F.col("row_id") % 10 == 0, "val").otherwise("train")
    rows = pairs(spark, sf_dir).select(
        "row_id", split.alias("split"), F.col("paraphrased_question").alias("question"), F.col("sparql_wikidata").alias("sparql_modf")
    )
    path = fresh_path(spark, "tokens")
    numbered = contiguous_index(rows, ["row_id"], ["split"])
    write_tokens(token_records(numbered, get_vocabulary(spark, "bytes")), path)
    return path


def q_token_table(spark, sf_dir):
    rows = read_tokens(spark, _token_table(spark, sf_dir), "val")
    ids, shown = F.col("encoded_text"), F.col("decoded_text")
    return rows.select(
        "split", "ord", "row_id", "org_text", joined(ids).alias("encoded_text"), joined(shown, "|").alias("decoded_text")
    )


def q_loader_batches(spark, sf_dir):
    tokens = read_tokens(spark, _token_table(spark, sf_dir))
    parts = [batch_stats(load_batches(tokens, s), ["split", "batch_id"]) for s in SETTINGS.batch_sizes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Batches.


def _numbered(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("org_text"))
    return contiguous_index(rows, ["conv_id", "turn"])


def _turns(spark, sf_dir, with_texts=False):
    return tokenize(_numbered(spark, sf_dir), get_vocabulary(spark, "bytes"), texts=with_texts)


def _batches(spark, sf_dir, with_texts=False):
    size = SETTINGS.batch_size("train")
    return _turns(spark, sf_dir, with_texts).withColumn("batch_id", batch_of(size))


def q_collate(spark, sf_dir):
    rows = collate(_batches(spark, sf_dir), SETTINGS)
    return rows.select(
        "batch_id",
        "ord",
        "conv_id",
        "turn",
        joined(F.col("inputs")).alias("inputs"),
        joined(F.col("targets")).alias("targets"),
    )


def q_collate_text(spark, sf_dir):
    rows = collate(_batches(spark, sf_dir, with_texts=True), SETTINGS, texts=True)
    return rows.select(
        "batch_id",
        "ord",
        joined(F.col("inputs_txt"), "|").alias("inputs_txt"),
        joined(F.col("targets_txt"), "|").alias("targets_txt"),
    )


def q_collate_custom(spark, sf_dir):
    """A collate function of one's own: ids to the right, the left filled up with -1."""

    def to_the_right(frame: pd.DataFrame) -> pd.DataFrame:
        width = max(len(ids) for ids in frame["encoded_text"])
        lines = [" ".join(["-1"] * (width - len(ids)) + [str(i) for i in ids]) for ids in frame["encoded_text"]]
        return frame[["batch_id", "ord"]].assign(inputs=lines)

    rows = _batches(spark, sf_dir).select("batch_id", "ord", "encoded_text")
    return collate_with(rows, to_the_right, "batch_id long, ord long, inputs string")


def q_batch_stats(spark, sf_dir):
    rows = _batches(spark, sf_dir)
    count = batch_count(rows, SETTINGS.batch_size("train"))
    return batch_stats(rows).withColumn("n_batches", count.scalar())


def q_batch_export(spark, sf_dir):
    collated = collate(_batches(spark, sf_dir), SETTINGS)
    matrices = export_batches(collated, ["inputs", "targets"])
    rows = lambda name: F.array_join(F.transform(name, lambda row: joined(row)), ";")
    return matrices.select("batch_id", rows("inputs").alias("inputs"), rows("targets").alias("targets"))


def q_batch_sink(spark, sf_dir):
    """The matrices of ``q_batch_export``, written with a commit in two parts and read back."""
    path = fresh_path(spark, "batches")
    collated = materialize(collate(_batches(spark, sf_dir), SETTINGS), "collated")
    for half in (0, 1):
        write_batches(export_batches(collated.where(F.col("batch_id") % 2 == half), ["inputs", "targets"]), path)
    rows = lambda name: F.array_join(F.transform(name, lambda row: joined(row)), ";")
    matrices = read_batches(spark, path, "batch_id long, inputs array<array<int>>, targets array<array<int>>")
    return matrices.select("batch_id", rows("inputs").alias("inputs"), rows("targets").alias("targets"))


def _stored_turns(spark, sf_dir):
    """Turns as a table laid out by batches."""
    path = fresh_path(spark, "turns")
    write_token_batches(_turns(spark, sf_dir).withColumn("split", F.lit("train")), path, SETTINGS, batches_per_file=200)
    return path


def q_collate_stored(spark, sf_dir):
    rows = collate_stored(read_token_batches(spark, _stored_turns(spark, sf_dir), "train"), SETTINGS)
    return rows.select(
        "batch_id",
        "ord",
        "conv_id",
        "turn",
        joined(F.col("inputs")).alias("inputs"),
        joined(F.col("targets")).alias("targets"),
    )


def q_record_stored(spark, sf_dir):
    found = read_record(spark, _stored_turns(spark, sf_dir), "train", 7)
    return found.select("ord", "conv_id", "turn", "org_text")


def q_record_at(spark, sf_dir):
    return record_at(_numbered(spark, sf_dir), 7).select("ord", "conv_id", "turn", "org_text")


def q_context_window(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    window = keep_last(F.col("encoded_text"), WINDOW)
    return rows.select("conv_id", "turn", joined(window).alias("context"))


# Scores.


def _scored(spark, sf_dir):
    """Embeddings as logits, their labels as targets; label 0 stands for an ignored target."""
    target = F.when(F.col("label") == 0, F.lit(SETTINGS.ignore_index)).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"), target.alias("target")
    )


def q_masked_loss(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("batch_id", batch_of(SETTINGS.batch_size("train"), "vec_id"))
    loss = mean_of_batches(batch_losses(rows))
    return loss.select(F.round("loss", 6).alias("loss"))


def q_batch_losses(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("batch_id", batch_of(SETTINGS.batch_size("test"), "vec_id"))
    return batch_losses(rows).select("batch_id", F.round("batch_loss", 6).alias("batch_loss"))


def q_eval_checkpoints(spark, sf_dir):
    step, inside = F.floor(F.col("vec_id") / 25), F.col("vec_id") % 25
    rows = _scored(spark, sf_dir).select(
        F.lit(0).alias("epoch"),
        step.alias("batch_id"),
        F.when(inside % 5 == 4, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.floor(inside / 8).alias("scored_batch"),
        "logits",
        "target",
    )
    losses = batch_losses(rows, ["epoch", "batch_id", "split", "scored_batch"])
    report = checkpoint_losses(losses, every=5)
    return report.select(
        "epoch",
        "batch_id",
        F.round("train_loss", 6).alias("train_loss"),
        F.round("val_loss", 6).alias("val_loss"),
        "report",
    )


def q_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("choice"))


def q_last_choice(spark, sf_dir):
    """Runs of eight vectors as the positions of a sequence."""
    rows = _scored(spark, sf_dir).select(
        batch_of(8, "vec_id").alias("sequence"), (F.col("vec_id") % 8).alias("pos"), "logits"
    )
    return next_choice(rows, ["sequence"])


def q_stored_loss(spark, sf_dir):
    """Four vectors to a sequence, a matrix of logits and an array of targets per row."""
    position = F.struct("vec_id", "logits", "target")
    held = _scored(spark, sf_dir).groupBy(batch_of(4, "vec_id").alias("ord")).agg(
        F.sort_array(F.collect_list(position)).alias("p")
    )
    rows = held.select(
        batch_of(SETTINGS.batch_size("test")).alias("batch_id"),
        F.col("p.logits").alias("logits"),
        F.col("p.target").alias("targets"),
    )
    return stored_loss(rows, SETTINGS).select(F.round("loss", 6).alias("loss"))


def _formula_logits() -> np.ndarray:
    """(id * 31 + place * 7) % 11 / 4 for ids 0 to 10; other ids have the logits of their remainder by 11."""
    return (np.arange(11)[:, None] * 31 + np.arange(BYTES_AND_PAD) * 7) % 11 / 4


def q_model_loss(spark, sf_dir):
    """A model whose logits follow from the input id by a formula, over bytes and a pad of 256."""

    def build():
        logits = _formula_logits()

        def score(rows: list[np.ndarray]) -> list[np.ndarray]:
            return [logits.take(np.asarray(ids) % 11, axis=0) for ids in rows]

        return score

    settings = Settings(pad_id=BYTES_AND_PAD - 1)
    return model_loss(_turns(spark, sf_dir), "train", build, settings).select(F.round("loss", 6).alias("loss"))


def q_sharded_loss(spark, sf_dir):
    """The loss of ``q_masked_loss`` with logits in slices of five, of sixteen or in one."""
    whole = F.size("logits")
    width = F.when(F.col("vec_id") % 3 == 0, 5).when(F.col("vec_id") % 3 == 1, 16).otherwise(whole)
    rows = _scored(spark, sf_dir).withColumns({"batch_id": batch_of(SETTINGS.batch_size("train"), "vec_id"), "width": width})
    begins = F.explode(F.sequence(F.lit(0), whole - 1, F.col("width"))).alias("start")
    cut = rows.select("batch_id", "vec_id", "target", "width", "logits", begins)
    shards = cut.withColumn("logits", F.slice("logits", F.col("start") + 1, F.col("width")))
    return mean_of_batches(sharded_batch_losses(shards, ["vec_id"])).select(F.round("loss", 6).alias("loss"))


def q_sliced_model_loss(spark, sf_dir):
    """The model of ``q_model_loss``, asked for a hundred logits at a time."""

    def build():
        logits = _formula_logits()

        def score(rows: list[np.ndarray], start: int, stop: int) -> list[np.ndarray]:
            part = np.ascontiguousarray(logits[:, start:stop])
            return [part.take(np.asarray(ids) % 11, axis=0) for ids in rows]

        return score

    settings = Settings(pad_id=BYTES_AND_PAD - 1)
    rows = model_inputs(_turns(spark, sf_dir), "train", settings)
    losses = sliced_model_batch_losses(rows, build, BYTES_AND_PAD, slice_ids=100, ignore=settings.ignore_index)
    return mean_of_batches(losses).select(F.round("loss", 6).alias("loss"))


def q_softmax(spark, sf_dir):
    probabilities = softmax(F.col("logits"))
    rows = _scored(spark, sf_dir).select("vec_id", F.posexplode(probabilities).alias("pos", "p"))
    return rows.select("vec_id", "pos", F.round("p", 8).alias("p"))


# Generation.


def q_next_token(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return next_token_table(table(spark, sf_dir, "benchmark").select(words.alias("words")), "words")


def q_greedy_decode(spark, sf_dir):
    """Encoded queries as questions, continued by the next-token table of the train prompts."""
    vocabulary = get_vocabulary(spark, "bytes")
    dictionary = corpus_dictionary(spark, sf_dir)
    coded = materialize(encode_ids(rename_pairs(pairs(spark, sf_dir)), dictionary, row_key=["row_id"]), "encoded")
    prompts = coded.select("row_id", render_prompt("train", F.col("question"), F.col("sparql_modf")).alias("org_text"))
    successors = next_token_table(tokenize(prompts, vocabulary, texts=False))
    questions = coded.select("row_id", F.col("sparql_modf").alias("question"), F.col("sparql").alias("org_sparql"))
    settings = Settings(context_length=GREEDY_WINDOW)
    rows = answer(questions, vocabulary, table_scorer(successors), dictionary, settings=settings)
    return rows.select("row_id", "decoded_text", "decoded_sparql", "org_sparql")


def _turns_and_successors(spark, sf_dir):
    """Turns, and a next-token table of turns with their end marked, so that the end is met."""
    vocabulary = get_vocabulary(spark, "bytes")
    turns = texts(spark, sf_dir, "conversations")
    ended = turns.select(F.concat("text", F.lit("<|endoftext|>")).alias("org_text"))
    successors = next_token_table(tokenize(ended, vocabulary, on_special="allow", texts=False))
    prompts = turns.select("conv_id", "turn", F.col("text").alias("org_text"))
    return tokenize(prompts, vocabulary, texts=False), successors


def q_greedy_stop(spark, sf_dir):
    coded, successors = _turns_and_successors(spark, sf_dir)
    grown = greedy_decode(coded, table_scorer(successors), settings=Settings(context_length=GREEDY_WINDOW))
    return grown.select("conv_id", "turn", joined(F.col("generated")).alias("generated"))


def q_greedy_states(spark, sf_dir):
    """The same with a scorer that is handed one id a step and prompt."""
    coded, successors = _turns_and_successors(spark, sf_dir)
    follow = table_scorer(successors)
    grown = greedy_decode(coded, lambda: TableWalker(follow()), settings=Settings(context_length=GREEDY_WINDOW))
    return grown.select("conv_id", "turn", joined(F.col("generated")).alias("generated"))


def q_greedy_joined(spark, sf_dir):
    """The same by joins, with the broadcast of walks switched off."""
    coded, successors = _turns_and_successors(spark, sf_dir)
    grown = follow_table(coded, successors, settings=Settings(context_length=GREEDY_WINDOW), broadcast_bytes=0)
    return grown.select("conv_id", "turn", joined(F.col("generated")).alias("generated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in list(globals().items()) if name.startswith("q_")
}

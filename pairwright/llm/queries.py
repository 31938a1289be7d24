"""One query for each operator, over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import (
    collocations,
    decontaminate,
    language,
    licences,
    mil,
    packing,
    pii,
    pitman_yor,
    quality_rules,
    simhash,
    spelling,
    token_counts,
    warc,
)
from pairwright.llm.sampling import remainder
from pairwright.workspace import fresh_path

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of a fifth of the ids are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = remainder("doc_id", 5) == 0
    model = mil.fit_quality(docs, labels.where(~held_out))
    scored = mil.score_quality(docs, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_lm_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; a tenth of the ids is not learnt from."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 10) == 0
    scored = pitman_yor.score_texts(docs.select(F.col("doc_id").alias("id"), "text", (~held_out).alias("train")))
    return scored.select(
        F.col("id").alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 1024)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def _joined(spans: str) -> Column:
    each = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, each), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit_pii(docs))
    return found.select(
        "doc_id", *map(_number, pii.KINDS), F.sha2(_joined("pii.base"), 256).alias("base_sha256"), _joined("pii.spans").alias("spans")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan_documents(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "passages.n_words",
        F.size("passages.hits").cast("long").alias("n_hit"),
        F.size("passages.items").cast("long").alias("n_items"),
        decontaminate.items_digest("passages.items").alias("items_sha256"),
        (F.size("passages.hits") > 0).alias("contaminated"),
    )


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document: how many, which, the best coefficient, and their word ranges."""
    found = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform(
        "licences", lambda l: F.concat_ws(":", l["licence"], l["start"].cast("string"), l["stop"].cast("string"))
    )
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("licences.licence")), ",").alias("licences"),
        F.array_max("licences.dice").alias("best_dice"),
        F.array_join(spans, ",").alias("notices"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = quality_rules.policy("web", 2)
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base_failed = quality_rules.fails(quality_rules.BASE)
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~quality_rules.fails(chosen)).alias("kept"),
        "fail_bits",
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = language.fit_language(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.pred").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def misspelt_words(docs: DataFrame, least_length: int = 7, every: int = 31) -> DataFrame:
    """(word, n): runs of letters of all texts, one in ``every`` by a checksum with a letter taken out."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[A-Za-z\u00C0-\u00FF]{{{least_length},}}"), 0)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.select("doc", spelling.lower_ascii(F.col("run")).alias("run"))
    check = F.crc32(F.encode(F.concat_ws(":", "doc", "run"), "utf-8"))
    each = each.select("run", check.alias("check"))
    cut = F.overlay("run", F.lit(""), (F.col("check") % F.char_length("run") + 1).cast("int"), F.lit(1))
    word = F.when(F.col("check") % every == 0, cut).otherwise(F.col("run"))
    counted = each.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word")
    return counted.agg(F.count("*").alias("n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their likely right spelling."""
    words = misspelt_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.spelling_variants(words.where(F.col("n") >= 2), ratio=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives says."""
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    key = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast(kind)
    return warc.read_archives(spark, path, with_payload=False).select(
        key("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), key("refers_to")).alias("refers_to"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_mil,
        op2_lm_pitman_yor,
        op3_simhash_dedup,
        op4_token_counts,
        op5_packing,
        op6_pii_semi_crf,
        op7_decontamination,
        op8_licence_scan,
        op9_quality_rules,
        op10_language_id,
        op11_spelling_variants,
        op12_collocations,
        op13_warc,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op7_decontamination": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS t
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc, sizes WHERE len(w) >= size)
), found AS (SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (size, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_quality_rules": rf"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), runs AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM doc WHERE len(w) >= 3)
), twice AS (SELECT doc_id, t FROM runs GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM runs JOIN twice USING (doc_id, t)) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, regexp_matches(text, '\p{{L}}') AS has_letter
  FROM doc LEFT JOIN covered USING (doc_id)
), bits AS (
  SELECT *, CAST((n_words < 50)::INT * 1 + (100 * n_repeat_words > 50 * n_words)::INT * 2 + (word_chars < 2 * n_words)::INT * 4
    + (word_chars > 14 * n_words)::INT * 8 + (100 * n_symbols > 30 * n_words)::INT * 16 + (100 * n_dup_lines > 50 * n_lines)::INT * 32
    + (n_words = 0)::INT * 64 + (NOT has_letter)::INT * 128 AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
  fail_bits & 191 = 0 AS kept, fail_bits FROM bits
""",
    "op12_collocations": r"""
WITH piece AS (
  SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
), split AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
runs AS (
  SELECT lang, size, unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: w[i : i + size - 1])) AS g
  FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size
), f AS (SELECT lang, size, g, CAST(count(*) AS HUGEINT) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM split GROUP BY lang),
candidate AS (SELECT * FROM f WHERE size >= 2),
within AS (
  SELECT DISTINCT lang, g[i : i + s - 1] AS g, s, max(f) AS longer
  FROM (SELECT lang, g, f, s, unnest(generate_series(1, size - s + 1)) AS i FROM candidate, (SELECT unnest([2, 3, 4]) AS s) WHERE s < size)
  GROUP BY lang, g[i : i + s - 1], s
), kept AS (
  SELECT c.* FROM candidate c LEFT JOIN within w ON c.lang = w.lang AND c.g = w.g WHERE w.longer IS NULL OR w.longer < c.f
), cut AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.g = c.g[: k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]
  JOIN total t ON t.lang = c.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM lowest
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
""",
    "op13_warc": """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM page),
last AS (SELECT payload_digest, max(page_id) AS last FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, sized.payload_digest AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM sized LEFT JOIN last ON sized.payload_digest = last.payload_digest AND payload_bytes >= 1000
""",
}

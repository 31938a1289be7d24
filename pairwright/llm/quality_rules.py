"""Quality rules as a ledger: every rule is evaluated once, its outcome is one bit.

The ledger holds the measurements and the failure bits of every row. A policy is a named,
versioned set of rules; applying one, or asking what a rule contributes to it, needs the bits
only. All of it is made of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word definition, as characters.
_WHITE = "\t\n\x0b\x0c\r "
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A row fails when ``fails`` holds; ``bit`` is its place in the mask and never changes."""

    name: str
    bit: int
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


def _share(part: str, whole: str, limit: float) -> Column:
    return F.col(part) * 100 > F.col(whole) * (limit * 100)


RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 50),
    Rule("repeated_windows", 1, lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("short_words", 2, lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", 3, lambda: F.col("word_chars") > 14 * F.col("n_words")),
    Rule("symbols", 4, lambda: _share("n_symbols", "n_words", 0.3)),
    Rule("repeated_lines", 5, lambda: _share("n_dup_lines", "n_lines", 0.5)),
    Rule("no_words", 6, lambda: F.col("n_words") == 0),
    Rule("no_letters", 7, lambda: ~F.col("has_letter")),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("web", 1, ("few_words", "repeated_windows", "short_words", "long_words", "symbols")),
    Policy("web", 2, ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "no_letters")),
)


def mask(policy: Policy) -> int:
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in policy.rules)


def policy(name: str, version: int) -> Policy:
    return next(p for p in POLICIES if (p.name, p.version) == (name, version))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


#: Up to so many repeated keys are looked for directly.
_FEW = 64
MEASURES = ["n_words", "word_chars", "n_symbols", "has_letter", "n_lines", "n_dup_lines", "n_repeat_words"]


def _with_places(keyed: DataFrame, kept: list[str]) -> DataFrame:
    """``_keys`` -> ``_at``: the places, in order, of the keys that occur more than once.

    Sorting brings equal keys together. A few repeated keys are then looked for directly. Where
    there are many, pairs of key and place are sorted and compared with their neighbours, so that
    the work stays in proportion to sorting however repetitive a text is.
    """
    ordered = keyed.select(*kept, "_keys", F.sort_array("_keys").alias("_sorted"))
    twice = F.array_distinct(F.filter("_sorted", lambda k, i: k == F.get("_sorted", i - 1)))
    repeated = ordered.select(*kept, "_keys", twice.alias("_twice"))
    number = F.size("_twice")
    pairs = F.sort_array(F.transform("_keys", lambda k, i: F.struct(k.alias("key"), i.alias("place"))))
    paired = repeated.select(*kept, "_keys", "_twice", F.when(number > _FEW, pairs).alias("_pairs"))
    direct = F.filter(
        F.sequence(F.lit(0), F.size("_keys") - 1), lambda i: F.array_contains("_twice", F.get("_keys", i))
    )
    near = lambda p, i: F.coalesce(F.get("_pairs", i)["key"] == p["key"], F.lit(False))
    by_pairs = F.transform(
        F.filter("_pairs", lambda p, i: near(p, i - 1) | near(p, i + 1)), lambda p: p["place"]
    )
    none = F.array().cast("array<int>")
    at = F.when(number == 0, none).when(number <= _FEW, direct).otherwise(F.sort_array(by_pairs))
    return paired.select(*kept, at.alias("_at"))


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and the measurements. Null counts as empty.

    Windows of three words are compared by their 64-bit hashes, within a document only.
    """
    others = [c for c in docs.columns if c != text_column]
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    split = docs.select(
        *others,
        _words(text).alias("_words"),
        lines.alias("_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        text.rlike("\\p{L}").alias("has_letter"),
    )
    hashed = split.select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "has_letter",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
        ).alias("_keys"),
    )
    kept = [*others, *MEASURES[:-1]]
    placed = _with_places(hashed, kept)
    # A window covers its three words, or those up to the next repeated window.
    covered = F.aggregate(
        F.transform("_at", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - at, F.lit(3)))),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    return placed.select(*kept, covered.cast("long").alias(MEASURES[-1]))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, measurements, fail_bits): one row for each row of ``docs``.

    Null and empty texts have no words: all measurements are 0 and the rules ``few_words`` and
    ``no_words`` fail, and ``no_letters``. Repeated rows and null ids stay as they are, an empty
    table gives an empty ledger. Only the id and the text are read, so other columns may have
    any name. Nothing is shuffled.
    """
    held = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    measured = measure(held, "_text").withColumnRenamed("_id", id_column)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def fails(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(entries: DataFrame, chosen: Policy, bits: str = "fail_bits") -> DataFrame:
    """(rule, fails, only_fails, kept, kept_without) of a policy's rules over a ledger.

    The ledger is counted once by its bits, of which there are two to the number of rules at
    most; everything else comes from those counts. ``only_fails`` rows fail no other rule.
    """
    counted = entries.groupBy(bits).agg(F.count("*").alias("rows"))
    whole = mask(chosen)
    masked = counted.withColumn("_bits", F.col(bits).bitwiseAND(F.lit(whole).cast("long")))
    kept = F.sum(F.when(F.col("_bits") == 0, F.col("rows")).otherwise(0))
    numbers = {rule.name: rule.bit for rule in RULES}
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << numbers[r]).cast("long").alias("bit")) for r in chosen.rules]))
    per_rule = masked.select("*", rules.alias("r")).groupBy("r.rule", "r.bit").agg(
        F.sum(F.when(F.col("_bits").bitwiseAND(F.col("r.bit")) != 0, F.col("rows")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("_bits") == F.col("r.bit"), F.col("rows")).otherwise(0)).alias("only_fails"),
        kept.alias("kept"),
    )
    return per_rule.select("rule", "fails", "only_fails", "kept", (F.col("kept") + F.col("only_fails")).alias("kept_without"))

"""Token vocabularies: a table of (id, token bytes), a pre-split pattern and special tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.config import END_OF_TEXT, END_OF_TEXT_ID

# Fixed value: the published GPT-2 pre-split pattern, with Unicode white space.
GPT2_PATTERN = (
    r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


@dataclass(frozen=True)
class Vocabulary:
    """``frame`` (id int, token binary) holds all 256 single bytes and one row per merge.

    The table goes to every task, so larger ids than ``max_entries`` allows are an error.
    """

    frame: DataFrame
    pattern: str = GPT2_PATTERN
    special: dict[str, int] = field(default_factory=lambda: {END_OF_TEXT: END_OF_TEXT_ID})
    max_entries: int = 500_000

    def checked_size(self) -> int:
        """One more than the largest id; ids too large for a vocabulary are an error."""
        largest = self.frame.agg(F.max("id")).first()[0]
        size = max([largest, *self.special.values()]) + 1
        if size > self.max_entries:
            raise ValueError(f"a vocabulary holds at most {self.max_entries} tokens")
        return size

    def merge_ranks(self) -> dict[bytes, int]:
        """The table on the driver, for broadcast; its size is checked first."""
        self.checked_size()
        rows = self.frame.select("id", "token").collect()
        ranks = {bytes(r["token"]): r["id"] for r in rows}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary has to hold every single byte")
        return ranks

    def pieces(self) -> DataFrame:
        """(id, hex, text) of ordinary and special tokens: what decoding looks up.

        ``text`` is the token on its own, with U+FFFD for bytes that are no whole character.
        """
        spark = self.frame.sparkSession
        special = spark.createDataFrame(
            [(i, bytearray(t.encode())) for t, i in self.special.items()], "id int, token binary"
        )
        return self.frame.select("id", "token").unionByName(special).select(
            "id",
            F.hex("token").alias("hex"),
            F.make_valid_utf8(F.col("token").cast("string")).alias("text"),
        )


def byte_vocabulary(spark: SparkSession, path: str | None = None) -> Vocabulary:
    """No merges: every byte is a token and its value is the id."""
    frame = spark.range(256).select(
        F.col("id").cast("int").alias("id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token")
    )
    return Vocabulary(frame)


def ranked_vocabulary(spark: SparkSession, path: str | None) -> Vocabulary:
    """Read lines of ``<token in base64> <id>``, the usual published form of merge ranks."""
    if path is None:
        raise ValueError("this vocabulary is read from a file: give its path")
    line = F.split(F.col("value"), " ")
    frame = (
        spark.read.text(path)
        .where(F.length("value") > 0)
        .select(F.get(line, F.lit(1)).cast("int").alias("id"), F.unbase64(F.get(line, F.lit(0))).alias("token"))
    )
    return Vocabulary(frame)


def write_ranked(frame: DataFrame, path: str) -> None:
    """Write (id, token) in the form that ``ranked_vocabulary`` reads."""
    frame.select(F.concat_ws(" ", F.base64("token"), F.col("id").cast("string"))).write.text(path)


VOCABULARIES: dict[str, Callable[[SparkSession, str | None], Vocabulary]] = {
    "bytes": byte_vocabulary,
    "gpt2": ranked_vocabulary,
}


def get_vocabulary(spark: SparkSession, name: str, path: str | None = None) -> Vocabulary:
    """A vocabulary by name; an unknown name is a ``KeyError``."""
    return VOCABULARIES[name](spark, path)

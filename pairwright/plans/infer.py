"""Questions to query text: prompt, tokens, greedy generation, text, labels back to ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.config import Settings
from pairwright.functions.prompt import render_prompt
from pairwright.operators.follow import follow_table
from pairwright.operators.generate import Scorer, greedy_decode
from pairwright.operators.rewrite import decode_labels
from pairwright.operators.tokens import detokenize, tokenize
from pairwright.sources.vocabulary import Vocabulary


def answer(
    questions: DataFrame,
    vocabulary: Vocabulary,
    scorer: Callable[[], Scorer] | DataFrame,
    dictionary: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """(question, org_sparql, …) -> the same rows with ``decoded_text`` and ``decoded_sparql``.

    ``scorer`` builds a scorer, or is a next-token table of any size. Labels are restored in the
    whole generated text, prompt included.
    """
    prompts = questions.withColumn("_prompt", render_prompt("test", F.col("question")))
    coded = tokenize(prompts, vocabulary, "_prompt", on_special="allow", texts=False)
    if isinstance(scorer, DataFrame):
        grown = follow_table(coded, scorer, settings=settings)
    else:
        grown = greedy_decode(coded, scorer, settings=settings)
    read = detokenize(grown, vocabulary, "generated", "decoded_text")
    restored = decode_labels(read, dictionary, "decoded_text", "decoded_sparql")
    return restored.select(*questions.columns, "decoded_text", "decoded_sparql")

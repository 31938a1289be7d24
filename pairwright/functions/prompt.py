"""Prompt text for one (question, query) row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.config import PROMPT_HEADER, PROMPT_QUERY, PROMPT_QUESTION


def _line(lead: str, value: Column, null_text: str | None) -> Column:
    shown = value if null_text is None else F.coalesce(value, F.lit(null_text))
    return F.when(F.length(shown) > 0, F.concat(F.lit(lead), shown)).otherwise(F.lit(""))


def render_prompt(
    mode: str, question: Column, query: Column | None = None, null_text: str | None = None
) -> Column:
    """Header, question line and, in ``train`` mode, the query line.

    An empty or null field contributes no line. ``null_text='nan'`` renders nulls the way
    a CSV reader that turns missing fields into NaN would show them.
    """
    parts = [F.lit(PROMPT_HEADER), _line(PROMPT_QUESTION, question, null_text)]
    if mode == "train":
        if query is None:
            raise ValueError("train prompts need the query column")
        parts.append(_line(PROMPT_QUERY, query, null_text))
    elif mode != "test":
        raise NotImplementedError(f"unknown prompt mode {mode!r}")
    return F.concat(*parts)

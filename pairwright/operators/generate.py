"""Greedy generation for a table of prompts, with a scorer of one's choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.config import Settings
from pairwright.functions.arrays import drop_first, drop_last
from pairwright.workspace import materialize

# A scorer takes a (prompts x window) matrix of ids, right-aligned and filled with -1 on the left,
# and returns either a (prompts x vocabulary) matrix of logits for the next position or one chosen
# id per prompt, negative where it has no continuation.
Scorer = Callable[[np.ndarray], np.ndarray]

#: Rows whose generated ids a task holds at a time, whatever Spark puts into a batch.
ROWS_AT_ONCE = 1024


class StatefulScorer(Protocol):
    """A scorer that keeps a state of each prompt, so that a step hands it one new id a prompt.

    Both methods return scores, in either form a ``Scorer`` returns, and a list of states.
    """

    def start(self, prompts: list[np.ndarray]) -> tuple[np.ndarray, list]:
        """Read whole windows, which may be empty."""

    def step(self, tokens: np.ndarray, states: list) -> tuple[np.ndarray, list]:
        """Read the id just chosen for each prompt. States of prompts that stopped are not handed in again."""


def next_token_table(tokens: DataFrame, ids: str = "encoded_text") -> DataFrame:
    """(prev, next): the most frequent successor of every token, the lowest one in a tie."""
    steps = F.arrays_zip(drop_last(F.col(ids)).alias("prev"), drop_first(F.col(ids)).alias("next"))
    counted = (
        tokens.where(F.size(ids) > 1)
        .select(F.explode(steps).alias("s"))
        .groupBy("s.prev", "s.next")
        .agg(F.count("*").alias("uses"))
    )
    best = F.min(F.struct((-F.col("uses")).alias("rank"), F.col("next")))
    return counted.groupBy("prev").agg(best.alias("best")).select("prev", F.col("best.next").alias("next"))


def table_scorer(successors: DataFrame, max_rows: int = 500_000) -> Callable[[], Scorer]:
    """A scorer that follows a next-token table of checked size (one row per vocabulary entry)."""
    kept = materialize(successors.select("prev", "next"), "successors")
    if kept.count() > max_rows:
        raise ValueError(f"a scorer holds {max_rows} rows at most; follow_table takes any number")
    rows = sorted((r["prev"], r["next"]) for r in kept.collect())
    held = successors.sparkSession.sparkContext.broadcast(np.array(rows, dtype=np.int64).reshape(-1, 2))

    def build() -> Scorer:
        prev, following = held.value[:, 0], np.append(held.value[:, 1], -1)

        def score(windows: np.ndarray) -> np.ndarray:
            last = windows[:, -1]
            place = np.searchsorted(prev, last)
            hit = np.append(prev, -2)[place] == last
            return following[np.where(hit, place, len(prev))]

        return score

    return build


def extend(
    values: np.ndarray, offsets: np.ndarray, score: Scorer, window: int, steps: int, stop_id: int
) -> list[np.ndarray]:
    """Grow every prompt of a batch; a stop leaves a sequence as it was before the step.

    The last ``window`` ids of each prompt are the left part of one matrix and each step fills one
    more column, so the windows of a step are a slice of it.
    """
    n, lengths = len(offsets) - 1, np.diff(offsets)
    source = offsets[1:, None] + np.arange(-window, 0)
    held = np.full((n, window + steps), -1, dtype=np.int32)
    if len(values):
        inside = source >= offsets[:-1, None]
        held[:, :window] = np.where(inside, values[np.maximum(source, 0)], -1)
    made = np.zeros(n, dtype=np.int64)
    alive = np.arange(n)
    for step in range(steps):
        if not len(alive):
            break
        scores = np.asarray(score(held[alive, step : step + window]))
        picks = scores.argmax(axis=-1) if scores.ndim == 2 else scores
        going = (picks >= 0) & (picks != stop_id)
        alive = alive[going]
        held[alive, window + step] = picks[going]
        made[alive] += 1
    kept = np.minimum(lengths + made - 1, window) + 1
    return [
        held[i, window + made[i] - kept[i] : window + made[i]]
        if made[i]
        else values[offsets[i] : offsets[i + 1]]
        for i in range(n)
    ]


def extend_by_states(
    values: np.ndarray, offsets: np.ndarray, scorer: StatefulScorer, window: int, steps: int, stop_id: int
) -> list[np.ndarray]:
    """``extend`` with a scorer that keeps its own states; a stopped prompt's state is dropped."""
    prompts = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    made: list[list[int]] = [[] for _ in prompts]
    alive = np.arange(len(prompts))
    scores, states = scorer.start([p[-window:] for p in prompts]) if steps else (None, [])
    for step in range(steps):
        scores = np.asarray(scores)
        picks = scores.argmax(axis=-1) if scores.ndim == 2 else scores
        going = np.flatnonzero((picks >= 0) & (picks != stop_id))
        alive, picks, states = alive[going], picks[going], [states[i] for i in going]
        for i, pick in zip(alive.tolist(), picks.tolist()):
            made[i].append(pick)
        if not len(alive) or step + 1 == steps:
            break
        scores, states = scorer.step(picks, states)
    out = []
    for prompt, added in zip(prompts, made):
        kept = min(len(prompt) + len(added) - 1, window) + 1
        out.append(np.append(prompt, added).astype(np.int32)[-kept:] if added else prompt)
    return out


class TableWalker:
    """A next-token table as a scorer whose state is the last id alone."""

    def __init__(self, follow: Scorer):
        self.follow = follow

    def start(self, prompts: list[np.ndarray]) -> tuple[np.ndarray, list]:
        return self.step(np.array([p[-1] if len(p) else -1 for p in prompts], np.int64), [])

    def step(self, tokens: np.ndarray, states: list) -> tuple[np.ndarray, list]:
        return self.follow(tokens[:, None]), tokens.tolist()


def greedy_decode(
    prompts: DataFrame,
    scorer: Callable[[], Scorer | StatefulScorer],
    ids: str = "encoded_text",
    out: str = "generated",
    settings: Settings = Settings(),
) -> DataFrame:
    """Add ``out``: the last ``context_length`` ids and what was generated after them.

    ``scorer`` is called once per task, so it may load a model; it sees ``rows_per_call``
    prompts at a time. One with ``start`` and ``step`` keeps its own states and is handed one id a step
    and prompt; others are handed the whole window. A null id list stays null.
    """
    window, steps, stop_id = settings.context_length, settings.max_new_tokens, settings.pad_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        grow = extend_by_states if hasattr(score, "step") else extend
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, len(b), ROWS_AT_ONCE)):
            lists = batch.column(ids)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            offsets = np.append(0, np.cumsum(sizes))
            grown = []
            for begin in range(0, len(lists), settings.rows_per_call):
                part = offsets[begin : begin + settings.rows_per_call + 1]
                own = values[part[0] : part[-1]]
                grown += grow(own, part - part[0], score, window, steps, stop_id)
            grown = [g if known else None for g, known in zip(grown, lists.is_valid().to_pylist())]
            added = pa.array(grown, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, added], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInArrow(run, f"{fields}, `{out}` array<int>")

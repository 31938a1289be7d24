"""Language of a text by sparse multinomial logistic regression on TF-IDF of character n-grams.

An n-gram lies within a word, lower-cased, with a mark at either end of the word. Term frequency
is the share of the text's n-grams, inverse document frequency is counted over all texts learnt
from. As both are linear in the words, a text's logits are sums of its words' logits, and each
distinct word of a batch is worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.sampling import labelled_sample
from pairwright.llm.texts import Words, code_points, letter_table, ranges, slices, sums

UNDETERMINED = "und"
ORDERS = (1, 2, 3, 4)
#: An n-gram of a distinct word takes some tens of bytes while a slice is worked on.
GRAM_SLICE_BYTES = 3 << 19
_MARK = np.uint64(1)


@dataclass(frozen=True)
class LanguageSettings:
    buckets: int = 1 << 15
    #: Rows the weights are fitted on, at most; document frequencies are counted on all.
    sample_rows: int = 2400
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    #: Term weights are shares of a text; this brings them to a scale the steps suit.
    scale: float = 100.0


class Grams:
    """The n-gram buckets of the distinct words of a slice, and which words the texts have."""

    def __init__(self, texts: pa.Array, buckets: int):
        letters, lower = letter_table()
        words = Words(texts)
        self.codes, distinct = words.coded()
        self.counts = words.counts
        self.first = words.first
        if not len(distinct):
            self.buckets, self.sizes, self.starts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        places = np.flatnonzero((data & 0xC0) != 0x80)
        points = code_points(data)
        owner = np.searchsorted(ends - ends[0], places, "right") - 1
        kept = letters[points]
        points, owner = lower[points[kept]].astype(np.uint64), owner[kept]
        # Each word with letters as: mark, letters, mark.
        size = np.bincount(owner, minlength=len(distinct))
        wide = np.where(size > 0, size + 2, 0)
        begins = np.cumsum(wide) - wide
        line = np.full(int(wide.sum()), _MARK, np.uint64)
        line[ranges(begins[size > 0] + 1, size[size > 0])] = points
        word = np.repeat(np.arange(len(distinct)), wide)
        found, of = [], []
        value = np.zeros(len(line), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            value = value[: len(line) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + line[order - 1 :] + np.uint64(order)
            if order not in ORDERS:
                continue
            mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = word[: len(value)] == word[order - 1 :]
            found.append(((mixed >> np.uint64(32)) % np.uint64(buckets))[inside].astype(np.int32))
            of.append(word[: len(value)][inside].astype(np.int32))
        of_all = np.concatenate(of)
        by_word = np.argsort(of_all, kind="stable")
        self.buckets = np.concatenate(found)[by_word].astype(np.int64)
        self.sizes = np.bincount(of_all, minlength=len(distinct))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def text(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, shares) of text i."""
        codes, times = np.unique(self.codes[self.first[i] : self.first[i + 1]], return_counts=True)
        sizes = self.sizes[codes]
        held = self.buckets[ranges(self.starts[codes], sizes)]
        found, at = np.unique(held, return_inverse=True)
        weight = np.bincount(at, np.repeat(times, sizes))
        return found, weight / max(1.0, weight.sum())


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # (buckets, labels), with inverse document frequency and scale in it
    bias: np.ndarray
    temperature: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        grams = Grams(texts, len(self.weights))
        n = len(texts)
        if not self.labels or not len(grams.codes):
            return [UNDETERMINED] * n, np.zeros(n)
        word = np.repeat(np.arange(len(grams.sizes)), grams.sizes)
        text = np.repeat(np.arange(n), grams.counts)
        totals = np.empty((n, len(self.labels)))
        for k in range(len(self.labels)):  # one label at a time, to hold one number for each n-gram
            by_word = np.bincount(word, self.weights[grams.buckets, k], len(grams.sizes))
            totals[:, k] = np.bincount(text, by_word[grams.codes], n)
        size = sums(grams.sizes[grams.codes].astype(np.float64), grams.first)
        logits = totals / np.maximum(size, 1)[:, None] + self.bias
        logits = (logits - logits.max(axis=1, keepdims=True)) / self.temperature
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = size > 0
        names = [self.labels[b] if k else UNDETERMINED for b, k in zip(best, known)]
        return names, np.where(known, p[np.arange(n), best], 0.0)


def document_frequencies(docs: DataFrame, buckets: int) -> tuple[int, np.ndarray]:
    """(texts with words, texts that hold each bucket), counted over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for part in slices(batch, limit=GRAM_SLICE_BYTES):
                grams = Grams(part.column("text"), buckets)
                for begin in range(0, len(part), 64):
                    first = grams.first[begin : begin + 65]
                    codes = grams.codes[first[0] : first[-1]]
                    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    pairs = np.unique(row * len(grams.sizes) + codes) if len(codes) else codes
                    row, codes = pairs // max(1, len(grams.sizes)), pairs % max(1, len(grams.sizes))
                    held = np.zeros((len(first) - 1, buckets), bool)
                    sizes = grams.sizes[codes]
                    held[np.repeat(row, sizes), grams.buckets[ranges(grams.starts[codes], sizes)]] = True
                    seen += held.sum(axis=0)
                    n += int(held.any(axis=1).sum())
        at = np.flatnonzero(seen)
        ids = np.append(at, -1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.append(seen[at], n))], ["bucket", "texts"])

    counted = docs.select("text").mapInArrow(run, "bucket long, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts"))
    out, n = np.zeros(buckets, np.int64), 0
    for row in counted.collect():  # one row for each bucket at most
        if row["bucket"] < 0:
            n = row["texts"]
        else:
            out[row["bucket"]] = row["texts"]
    return n, out


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, settings: LanguageSettings) -> np.ndarray:
    """Weights (buckets, labels) by follow-the-regularised-leader with elastic net, row by row."""
    z = np.zeros((settings.buckets, labels))
    n = np.zeros((settings.buckets, labels))

    def leader(at: np.ndarray) -> np.ndarray:
        za, step = z[at], (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(np.abs(za) <= settings.l1, 0.0, -(za - np.sign(za) * settings.l1) / step)

    order = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = leader(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return leader(np.arange(settings.buckets))


def temperature_of(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature, of a geometric grid, with the least loss on rows the weights have not seen."""
    if not len(targets):
        return 1.0
    grid = np.geomspace(0.5, 20, 121)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(targets)), targets] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_language(
    docs: DataFrame, id_column: str = "doc_id", label: str = "lang", settings: LanguageSettings = LanguageSettings()
) -> LanguageModel:
    """Fit on rows with text and label. No such row gives a model that answers ``und`` only.

    A fifth of the sample is kept from the weights and sets the temperature.
    """
    usable = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    n, frequency = document_frequencies(usable, settings.buckets)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sample = labelled_sample(usable, [id_column, "text"], label, settings.sample_rows).select("text", F.col(label).cast("string").alias("label"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=GRAM_SLICE_BYTES):
                grams = Grams(part.column("text"), settings.buckets)
                made = [grams.text(i) for i in range(len(part))]
                found = pa.array([m[0] for m in made], pa.list_(pa.int32()))
                share = pa.array([m[1] for m in made], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("label"), found, share], ["label", "found", "share"])

    rows = sample.mapInArrow(featurise, "label string, found array<int>, share array<float>").toArrow()
    names = rows.column("label").to_pylist()
    labels = sorted(set(names))
    held = []
    for found, share, name in zip(rows.column("found"), rows.column("share"), names):
        at = np.asarray(found.values, np.int64)
        if len(at):
            held.append((at, np.asarray(share.values, np.float64) * idf[at] * settings.scale, labels.index(name)))
    if not held:
        return LanguageModel([], np.zeros((settings.buckets, 0)), np.zeros(0), 1.0)
    held.sort(key=lambda r: (len(r[0]), r[2], r[0].tolist()))  # the same order in every run
    weights = fit_ftrl([r for i, r in enumerate(held) if i % 5], len(labels), settings)
    kept = held[::5]
    logits = np.array([x @ weights[at] for at, x, _ in kept])
    temperature = temperature_of(logits, np.array([y for _, _, y in kept]))
    return LanguageModel(labels, weights * (idf * settings.scale)[:, None], np.zeros(len(labels)), temperature)


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``language``: pred, score.

    A null text and one without a letter get ``und`` and score 0; repeated rows get the same
    result; an empty table stays empty. Whole texts are read; nothing is shuffled. The model is
    one weight for each bucket and label, a few MB whatever it was fitted on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), limit=GRAM_SLICE_BYTES):
            n, s = sent.value.predict(part.column("text"))
            names += n
            scores.append(s)
        score = pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), score], ["pred", "score"])

    run = F.arrow_udf(predict, "struct<pred:string,score:double>").asNondeterministic()
    return docs.withColumn("language", run(F.col(text_column).cast("string")))

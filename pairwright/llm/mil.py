"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded; gated attention
weights say how much each counts; the weighted sum of the encodings is scored. Labels are known
for documents only, and what the attention looks at is learnt from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.sampling import labelled_sample
from pairwright.llm.texts import Words, slices

PASSAGE = 64
FEATURES = 15


@dataclass(frozen=True)
class MilSettings:
    #: Labelled documents the network is fitted on, at most.
    sample_rows: int = 3000
    hidden: int = 24
    attention: int = 12
    epochs: int = 60
    batch: int = 256
    rate: float = 0.01
    decay: float = 1e-4


def _byte_kinds() -> np.ndarray:
    """0 upper case, 1 lower case, 2 digit, 3 stop or comma, 4 symbol, 5 other ASCII, 6 beyond ASCII."""
    kinds = np.full(256, 6, np.int64)
    for b in range(128):
        c = chr(b)
        kinds[b] = 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 if c in ".,;:?" else 4 if c in "#*$%&|<>!" else 5
    return kinds


_KINDS = _byte_kinds()


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text). A text without words has one empty passage."""
    words = Words(texts)
    n_words, lengths = words.counts, words.lengths
    n = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n)])
    total = int(first[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not len(words):
        out[:, 14] = 1
        return out, first
    place = np.arange(len(lengths)) - np.repeat(words.first[:-1], n_words)
    passage = np.repeat(first[:-1], n_words) + place // PASSAGE
    size = np.bincount(passage, minlength=total)
    per = np.maximum(size, 1)
    chars = np.bincount(passage, lengths, total)
    kinds = np.bincount(np.repeat(passage * 7, lengths) + _KINDS[words.data], minlength=total * 7).reshape(-1, 7)
    out[:, :7] = kinds / np.maximum(chars, 1)[:, None]
    out[:, 7] = chars / per / 8
    out[:, 8] = np.sqrt(np.maximum(0, np.bincount(passage, lengths**2, total) / per - (chars / per) ** 2)) / 8
    out[:, 9] = np.bincount(passage, lengths > 14, total) / per
    out[:, 10] = np.bincount(passage, lengths <= 2, total) / per
    codes = words.hashes()
    order = np.lexsort((codes, passage))
    fresh = np.concatenate([[True], (codes[order][1:] != codes[order][:-1]) | (passage[order][1:] != passage[order][:-1])])
    out[:, 11] = np.bincount(passage[order][fresh], minlength=total) / per  # share of different words
    again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])])
    out[:, 12] = np.bincount(passage[again], minlength=total) / per
    out[:, 13] = np.minimum(size, PASSAGE) / PASSAGE
    out[:, 14] = size == 0
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class MilModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(((x - self.mean) / self.spread) @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        e = (t * g) @ w["attend"]
        top = np.maximum.reduceat(e, first[:-1])
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(e - top[owner])
        a = a / np.add.reduceat(a, first[:-1])[owner]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "owner": owner, "p": _sigmoid(z @ w["score"] + w["bias"])}

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        x, first = passages(texts)
        return self.forward(x, first)["p"].astype(np.float64)


def fit(bags: list[np.ndarray], labels: np.ndarray, settings: MilSettings) -> MilModel:
    """Adam on the mean logistic loss of the documents."""
    rng = np.random.default_rng(0)
    every = np.concatenate(bags)
    d, k = settings.hidden, settings.attention
    model = MilModel(
        every.mean(axis=0),
        every.std(axis=0) + 1e-3,
        {
            "encode": rng.normal(0, 0.3, (FEATURES, d)),
            "encode_bias": np.zeros(d),
            "tanh": rng.normal(0, 0.3, (d, k)),
            "gate": rng.normal(0, 0.3, (d, k)),
            "attend": rng.normal(0, 0.3, k),
            "score": rng.normal(0, 0.3, d),
            "bias": np.array(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))),
        },
    )
    w = model.weights
    moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in w.items()}
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(bags))
        for begin in range(0, len(order), settings.batch):
            chosen = order[begin : begin + settings.batch]
            x = np.concatenate([bags[i] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            f = model.forward(x, first)
            xs = (x - model.mean) / model.spread
            ds = (f["p"] - labels[chosen]) / len(chosen)
            dz = ds[:, None] * w["score"]
            da = (dz[f["owner"]] * f["h"]).sum(axis=1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["owner"]])
            dtg = de[:, None] * w["attend"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dz[f["owner"]] + dt @ w["tanh"].T + dg @ w["gate"].T
            du = dh * (1 - f["h"] ** 2)
            grads = {
                "encode": xs.T @ du, "encode_bias": du.sum(axis=0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg,
                "attend": (f["t"] * f["g"]).T @ de, "score": f["z"].T @ ds, "bias": ds.sum(),
            }
            step += 1
            for name, g in grads.items():
                g = g + settings.decay * w[name]
                m, v = moments[name]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[name] = (m, v)
                w[name] = w[name] - settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", settings: MilSettings = MilSettings()
) -> MilModel | None:
    """Fit on a bounded sample of the labelled documents, as evenly over the labels as they have rows.

    A document with several labels counts with the least; null labels and null ids are left out.
    Without any label there is no model. Only encoded passages of the sample come to the driver.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(id_column).agg(
        F.min(label).cast("int").alias("label")
    )
    sample = labelled_sample(known, [id_column], "label", settings.sample_rows)
    texts = docs.select(id_column, F.col("text").cast("string").alias("text")).join(F.broadcast(sample), id_column)
    # An id may have many rows.
    if texts.select(id_column).limit(2 * settings.sample_rows + 1).count() > 2 * settings.sample_rows:
        texts = texts.limit(settings.sample_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, first = passages(part.column("text"))
                flat = [x[a:b].ravel() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(flat, pa.list_(pa.float32()))], ["label", "x"])

    rows = texts.select("label", "text").mapInArrow(encode, "label int, x array<float>").toArrow()
    found = sorted(
        ((y, x.values.to_numpy().tobytes()) for y, x in zip(rows.column("label").to_pylist(), rows.column("x"))),
        key=lambda r: (r[0], r[1]),
    )
    if not found:
        return None
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x in found]
    return fit(bags, np.array([y for y, _ in found], float), settings)


def score_quality(docs: DataFrame, model: MilModel | None, text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``quality_score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts are one empty passage and get its score. Repeated rows get the same
    score, an empty table stays empty. Without a model every score is 0.5. Nothing is shuffled.
    """
    if model is None:
        return docs.withColumn("quality_score", F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        parts = [sent.value.score(p.column("text")) for p in slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    run = F.arrow_udf(score, "double").asNondeterministic()
    return docs.withColumn("quality_score", run(F.col(text_column).cast("string")))

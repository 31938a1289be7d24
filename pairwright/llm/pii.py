"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field works on regions, runs of words that hold a digit or an at sign. A region is a row of
atoms (letters, digits, single other characters, blanks). A segment is a run of up to
``MAX_ATOMS`` atoms with a type; its features look at the whole span. The sum over all ways to
cut a region into segments gives the likelihood it is trained on, the best cut its decision.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 20
#: Atoms of a region whose segments are held at once.
ATOMS_AT_ONCE = 512

# The patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number is tried from its first digit only: what fails there fails from every later one.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|[ \t]+|.", re.DOTALL)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, in order of start and then of kind."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    found += [
        ("ip", m.start(), m.end())
        for m in _IP.finditer(text)
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
    ]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of words with a digit or an at sign, with at most two blanks and no line break between."""
    out: list[tuple[int, int]] = []
    for m in _WORD.finditer(text):
        if _ANY.search(m[0]):
            if out and m.start() - out[-1][1] <= 2 and "\n" not in text[out[-1][1] : m.start()]:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
    return out


def atoms(text: str) -> list[int]:
    """Ends of the atoms of a region, with 0 before them."""
    return [0, *(m.end() for m in _ATOM.finditer(text))]


def features(region: str, start: int, stop: int) -> list[float]:
    """Of a whole span: what it is made of, whether it is valid as a kind, what stands beside it."""
    span = region[start:stop]
    digits = _digits(span)
    before = region[start - 1] if start else " "
    after = region[stop] if stop < len(region) else " "
    parts = span.split(".")
    email = span.count("@") == 1 and span[0] != "@" and _DOMAIN.fullmatch(span[span.index("@") + 1 :]) is not None
    n = len(digits)
    return [
        1.0,
        float(email and all(c in _LOCAL for c in span[: span.index("@")])),
        float(len(parts) == 4 and all(len(_digits(p)) == len(p) and 0 < len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(_CARD.fullmatch(span) is not None and 14 <= n <= 19 and luhn(digits)),
        float(_PHONE.fullmatch(span) is not None and 10 <= n <= 15),
        float(14 <= n <= 19),
        float(10 <= n <= 13),
        float(n < 10),
        float(any(c.isalpha() for c in span)),
        float(span[0] == "+"),
        float("@" in span),
        float(span[0].isspace() or span[-1].isspace()),
        float(before.isalnum() or before in "+.@-_"),
        float(after.isalnum() or after in "@-_"),
        float(not (span[-1].isalnum() and (span[0].isalnum() or span[0] in "+("))),
        float(span.count("-") + span.count(" ") + span.count("(") >= 2),
    ]


N_FEATURES = len(features("0", 0, 1))


@dataclass
class Lattice:
    """The segments of a region: atoms ``[i, j)`` as (i, j) and their features."""

    ends: list[int]
    pairs: list[tuple[int, int]]
    x: np.ndarray

    @staticmethod
    def of(region: str) -> Lattice:
        ends = atoms(region)
        return Lattice.between(region, ends, 0, len(ends) - 1)

    @staticmethod
    def between(region: str, ends: list[int], first: int, last: int) -> Lattice:
        """The segments that start at the atoms ``[first, last)``."""
        pairs, rows = [], []
        n = len(ends) - 1
        for i in range(first, last):
            if region[ends[i]].isspace():
                continue
            for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
                if region[ends[j] - 1].isspace():
                    continue
                pairs.append((i, j))
                rows.append(features(region, ends[i], ends[j]))
        return Lattice(ends, pairs, np.array(rows).reshape(-1, N_FEATURES))


@dataclass
class SemiMarkov:
    """Weights by feature and type; an atom outside any span scores 0."""

    weights: np.ndarray

    def _scores(self, held: Lattice) -> np.ndarray:
        return held.x @ self.weights

    def decode(self, region: str) -> list[Span]:
        """The best cut of a region into spans and single atoms outside them.

        The sum at an atom is final once all segments that start before it are in, so segments
        are worked out by their starts, ``ATOMS_AT_ONCE`` atoms at a time; of a long region only
        the sums and the best last segment at each atom are kept.
        """
        ends = atoms(region)
        n = len(ends) - 1
        best, back = [0.0] + [-np.inf] * n, [(-1, -1)] * (n + 1)
        for first in range(0, n, ATOMS_AT_ONCE):
            last = min(n, first + ATOMS_AT_ONCE)
            held = Lattice.between(region, ends, first, last)
            scores = self._scores(held)
            kinds = scores.argmax(axis=1).tolist()
            tops = scores.max(axis=1).tolist()
            k = 0
            for i in range(first, last):
                if i and best[i - 1] >= best[i]:
                    best[i], back[i] = best[i - 1], (-1, -1)
                while k < len(held.pairs) and held.pairs[k][0] == i:
                    value, j = best[i] + tops[k], held.pairs[k][1]
                    if value > best[j]:
                        best[j], back[j] = value, (i, kinds[k])
                    k += 1
        out, j = [], n
        if n and best[n - 1] >= best[n]:
            back[n] = (-1, -1)
        while j:
            i, kind = back[j]
            if i < 0:
                j -= 1
                continue
            out.append((KINDS[kind], ends[i], ends[j]))
            j = i
        return out[::-1]

    def gradient(self, held: Lattice, gold: set[tuple[int, int, int]]) -> np.ndarray:
        """Of the log-likelihood: features of the given segments less those expected."""
        n = len(held.ends) - 1
        scores = self._scores(held)
        summed = np.logaddexp.reduce(scores, axis=1)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(held.pairs):
            by_end[j].append(k)
            by_start[i].append(k)
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[held.pairs[k][0]] + summed[k] for k in by_end[j])])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[held.pairs[k][1]] + summed[k] for k in by_start[i])])
        at = np.array(held.pairs).reshape(-1, 2)
        p = np.exp(ahead[at[:, 0]][:, None] + scores + behind[at[:, 1]][:, None] - ahead[n])
        for k, (i, j) in enumerate(held.pairs):
            for t in range(len(KINDS)):
                if (i, j, t) in gold:
                    p[k, t] -= 1
        return -held.x.T @ p


@dataclass(frozen=True)
class PiiSettings:
    #: Texts with a digit or an at sign that regions are taken from, at most (in expectation).
    sample_rows: int = 1500
    #: Regions the weights are fitted on, at most.
    regions: int = 600
    epochs: int = 6
    rate: float = 0.3
    decay: float = 1e-3


def fit_field(examples: list[tuple[str, tuple[Span, ...]]], settings: PiiSettings = PiiSettings()) -> SemiMarkov:
    """AdaGrad on the likelihood of the given spans of each region; without regions nothing is ever added."""
    model = SemiMarkov(np.zeros((N_FEATURES, len(KINDS))))
    model.weights[0] = -4.0
    seen = np.full_like(model.weights, 1e-2)
    made = []
    for region, spans in examples:
        held = Lattice.of(region)
        place = {end: i for i, end in enumerate(held.ends)}
        gold = {(place[a], place[b], KINDS.index(k)) for k, a, b in spans if a in place and b in place}
        if held.pairs:
            made.append((held, gold))
    order = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for i in order.permutation(len(made)):
            g = model.gradient(*made[i]) - settings.decay * model.weights
            seen += g * g
            model.weights += settings.rate * g / np.sqrt(seen)
    return model


def examples_of(text: str) -> list[tuple[str, tuple[Span, ...]]]:
    """Regions with the base spans that lie in them; spans that overlap an earlier one are left out."""
    spans = base_spans(text)
    out = []
    for start, stop in regions(text):
        own: list[Span] = []
        for kind, a, b in spans:
            if a >= start and b <= stop and (not own or a - start >= own[-1][2]):
                own.append((kind, a - start, b - start))
        if stop - start <= 200:
            out.append((text[start:stop], tuple(own)))
    return out


def fit_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: PiiSettings = PiiSettings()) -> SemiMarkov:
    """Fit on regions of a bounded sample of the texts that hold a digit or an at sign.

    The base spans are its labels, so it learns their look and adds spans that look alike.
    """
    held = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where(
        F.col("text").rlike("[0-9@]")
    )
    n = held.count()
    rate = min(1.0, settings.sample_rows / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit("pii"), "id"), F.lit(1 << 30)) / float(1 << 30)
    kind = "array<struct<region:string,spans:array<struct<kind:string,start:int,stop:int>>>>"
    find = F.udf(lambda text: [(r, list(s)) for r, s in examples_of(text)], kind)
    rows = (
        held.where(draw < rate)
        .select(F.explode(find("text")).alias("e"))
        .select("e.region", "e.spans")
        .distinct()
        .orderBy(F.xxhash64("region"), "region")
        .limit(settings.regions)
        .collect()
    )
    return fit_field([(r["region"], tuple((s["kind"], s["start"], s["stop"]) for s in r["spans"])) for r in rows], settings)


def find_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): those of the field are added where no base span lies."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    added = []
    # Where base spans cover the text, as runs in order, so that a look to the left is enough.
    covers: list[tuple[int, int]] = []
    for _, a, b in base:
        if covers and a < covers[-1][1]:
            covers[-1] = (covers[-1][0], max(b, covers[-1][1]))
        else:
            covers.append((a, b))
    begins = [a for a, _ in covers]
    for start, stop in regions(text):
        for kind, a, b in model.decode(text[start:stop]):
            a, b = a + start, b + start
            left = bisect_left(begins, b) - 1  # the last run that begins before the span ends
            if left < 0 or covers[left][1] <= a:
                added.append((kind, a, b))
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
_ARROW = pa.struct([("base", pa.list_(_SPAN)), ("spans", pa.list_(_SPAN))])
_KIND = "struct<base:{0},spans:{0}>".format("array<struct<kind:string,start:int,stop:int>>")


def find_pii(docs: DataFrame, model: SemiMarkov, text_column: str = "text", out: str = "pii") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``out``: base and all spans, in code points.

    Null and empty texts have none. Repeated rows get the same spans, an empty table stays empty.
    Whole texts are read, and nothing is shuffled; only regions go through the field, whose work
    grows with their length times ``MAX_ATOMS``, and whose memory holds a few numbers an atom.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = lambda spans: [{"kind": k, "start": a, "stop": b} for k, a, b in spans]

    def find(texts: pa.Array) -> pa.Array:
        found = (find_spans(t or "", sent.value) for t in texts.to_pylist())
        return pa.array([{"base": rows(b), "spans": rows(s)} for b, s in found], _ARROW)

    return docs.withColumn(out, F.arrow_udf(find, _KIND).asNondeterministic()(F.col(text_column).cast("string")))


def redact(docs: DataFrame, model: SemiMarkov, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of the text replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the kind of the first. Null texts stay null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for kind, a, b in find_spans(text, sent.value)[1]:
            if a >= done:
                out += [text[done:a], f"[{kind}]"]
            done = max(done, b)
        return "".join(out) + text[done:]

    run = F.arrow_udf(lambda texts: pa.array([clean(t) for t in texts.to_pylist()], pa.string()), "string")
    return docs.withColumn(text_column, run.asNondeterministic()(F.col(text_column)))

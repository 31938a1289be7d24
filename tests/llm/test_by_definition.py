"""Quality, licences and languages against plain Python that follows their definitions step by step."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairwright.llm import language, licences, mil
from pairwright.llm.language import Grams, LanguageSettings


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def mil_score(model, bag):
    """One document: encode, attend, weigh, score."""
    w = {k: v.tolist() for k, v in model.weights.items()}
    dot = lambda x, m, j: sum(a * row[j] for a, row in zip(x, m))
    encoded, marks = [], []
    for x in bag:
        x = [(a - m) / s for a, m, s in zip(x, model.mean, model.spread)]
        h = [math.tanh(dot(x, w["encode"], j) + b) for j, b in enumerate(w["encode_bias"])]
        gated = [math.tanh(dot(h, w["tanh"], j)) * sigmoid(dot(h, w["gate"], j)) for j in range(len(w["attend"]))]
        encoded.append(h)
        marks.append(math.exp(sum(a * b for a, b in zip(gated, w["attend"]))))
    z = [sum(m * h[j] for m, h in zip(marks, encoded)) / sum(marks) for j in range(len(encoded[0]))]
    return sigmoid(sum(a * b for a, b in zip(z, w["score"])) + w["bias"])


def documents(seed, n):
    rng = random.Random(seed)
    words = ["one", "Two", "three,", "12", "ÄÖ", "#*", "longer-words-than-most", "a", "a"]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 30, 64, 65, 400]))) for _ in range(n)]


def test_quality_scores():
    texts = documents(1, 40)
    x, first = mil.passages(pa.array(texts))
    bags = [x[a:b] for a, b in zip(first[:-1], first[1:])]
    model = mil.fit(bags, np.array([i % 2 for i in range(40)], float), mil.MilSettings(hidden=5, attention=3, epochs=4, batch=7))
    got = model.score(pa.array(texts))
    assert got == pytest.approx([mil_score(model, bag) for bag in bags], abs=1e-6)
    assert [len(b) for b in bags] == [max(1, -(-len(t.split()) // 64)) for t in texts]


def test_quality_learns_down_the_slope():
    """A first step of the fit is along the gradient that small changes of each weight give."""
    texts = documents(2, 12)
    x, first = mil.passages(pa.array(texts))
    bags = [x[a:b] for a, b in zip(first[:-1], first[1:])]
    y = np.array([i % 3 == 0 for i in range(12)], float)
    settings = mil.MilSettings(hidden=3, attention=2, epochs=1, batch=100, rate=1e-3, decay=0.0)
    start = mil.fit(bags, y, mil.MilSettings(hidden=3, attention=2, epochs=0, batch=100))
    after = mil.fit(bags, y, settings)

    def loss():
        p = start.forward(x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, held in start.weights.items():
        moved = after.weights[name] - held
        for at in np.ndindex(held.shape):
            kept = float(held[at])
            held[at] = kept + 1e-5
            up = loss()
            held[at] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            held[at] = kept
            # The first step of Adam goes by the rate against the sign of the gradient.
            if abs(slope) > 1e-5:
                assert moved[at] == pytest.approx(-1e-3 * np.sign(slope), rel=0.05)


GIVEN = (("one", "alpha beta gamma delta epsilon"), ("two", "beta gamma delta zeta zeta zeta"), ("three", "eta theta eta theta eta"))


def best_passages(words, least):
    found = []
    for name, text in GIVEN:
        held = text.split()
        want = Counter(zip(held, held[1:]))
        for start in range(len(words) - 1):
            best = None
            for stop in range(start + 2, len(words) + 1):
                have = Counter(zip(words[start:stop], words[start + 1 : stop]))
                dice = 2 * sum((want & have).values()) / (sum(want.values()) + sum(have.values()))
                if dice >= least and (best is None or dice > best[0]):
                    best = (dice, stop)
            if best:
                found.append((-best[0], start, best[1], name))
    kept = []
    for score, start, stop, name in sorted(found):
        if all(stop <= a or start >= b for _, _, a, b in kept):
            kept.append((name, -score, start, stop))
    return sorted(kept, key=lambda k: k[2])


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9])
def test_every_passage_against_every_licence(least):
    rng = random.Random(int(least * 100))
    names = "alpha beta gamma delta epsilon zeta eta theta other".split()
    texts = []
    for _ in range(150):
        words = rng.choices(names, k=rng.randint(0, 14))
        for _ in range(rng.randint(0, 2)):
            words[rng.randint(0, len(words)) :][:0] = []
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(GIVEN)[1].split()[: rng.randint(3, 6)]
        texts.append(" ".join(words))
    scanner = licences.Scanner(licences.templates(GIVEN), least)
    hits = 0
    for text, got in zip(texts, scanner.scan(pa.array(texts))):
        want = best_passages(text.split(), least)
        assert [(g["licence"], pytest.approx(g["dice"]), g["start"], g["stop"]) for g in got] == want
        hits += len(got)
    assert hits > 20


def test_many_notices_in_one_text_take_linear_time():
    scanner = licences.Scanner(licences.templates(GIVEN), 0.9)

    def seconds(n):
        text = pa.array(["alpha beta gamma delta epsilon and " * n])
        begun = time.process_time()
        assert len(scanner.scan(text)[0]) == n
        return time.process_time() - begun

    assert seconds(40_000) < 8 * max(seconds(10_000), 0.05)


def naive_ftrl(rows, labels, s):
    """The update of each weight on its own, from the published rule."""
    z, n = Counter(), Counter()

    def weight(j, k):
        if abs(z[j, k]) <= s.l1:
            return 0.0
        return -(z[j, k] - math.copysign(s.l1, z[j, k])) / ((s.beta + math.sqrt(n[j, k])) / s.alpha + s.l2)

    order = np.random.default_rng(0)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            logits = [sum(v * weight(j, k) for j, v in zip(at.tolist(), x.tolist())) for k in range(labels)]
            whole = sum(math.exp(v - max(logits)) for v in logits)
            p = [math.exp(v - max(logits)) / whole for v in logits]
            held = {(j, k): weight(j, k) for j in at.tolist() for k in range(labels)}
            for j, v in zip(at.tolist(), x.tolist()):
                for k in range(labels):
                    g = v * (p[k] - (k == y))
                    sigma = (math.sqrt(n[j, k] + g * g) - math.sqrt(n[j, k])) / s.alpha
                    z[j, k] += g - sigma * held[j, k]
                    n[j, k] += g * g
    return np.array([[weight(j, k) for k in range(labels)] for j in range(s.buckets)])


def test_weights_follow_the_rule_of_each_step():
    rng = np.random.default_rng(4)
    s = LanguageSettings(buckets=12, epochs=2, l1=0.05)
    rows = []
    for i in range(30):
        at = np.sort(rng.choice(12, rng.integers(1, 6), replace=False))
        rows.append((at, rng.random(len(at)) * 3, i % 3))
    got = language.fit_ftrl(rows, 3, s)
    want = naive_ftrl(rows, 3, s)
    assert got == pytest.approx(want) and (got == 0).any() and (got != 0).any()


def test_predictions_are_sums_over_n_grams():
    rng = np.random.default_rng(5)
    model = language.LanguageModel(["a", "b", "c"], rng.normal(size=(64, 3)) * 9, rng.normal(size=3), 1.7)
    texts = ["some words, some more", "Ünïcode wörter ÜNÏCODE", "x", "12 !!", "", None, "some " * 500]
    names, scores = model.predict(pa.array(texts))
    grams = Grams(pa.array(texts), 64)
    for i, (name, score) in enumerate(zip(names, scores)):
        at, share = grams.text(i)
        if not len(at):
            assert (name, score) == ("und", 0.0)
            continue
        logits = [(sum(v * model.weights[j, k] for j, v in zip(at, share)) + model.bias[k]) / 1.7 for k in range(3)]
        p = np.exp(np.array(logits) - max(logits))
        assert name == "abc"[int(np.argmax(p))] and score == pytest.approx(p.max() / p.sum())


def test_n_grams_of_a_text_by_hand():
    """Letters of a word between two marks, one to four at a time, lower-cased."""
    grams = Grams(pa.array(["Ab, ab c1d", "ab ab cd"]), 1 << 20)
    first, second = grams.text(0), grams.text(1)
    assert first[0].tolist() == second[0].tolist() and first[1].tolist() == second[1].tolist()
    assert first[1].sum() == pytest.approx(1) and len(first[0]) == 5 + 6 + 4 + 2  # the mark is one of five

"""Toxicity: maximum-scoring passages over token log-odds.

Training compares the shares of a feature among the words of toxic and of other
texts: a word (a run of letters, lower-cased) or a leading part of it. Log-odds
are taken with an informative Dirichlet prior, the feature's share in both
classes together, so rare features shrink to 0; what counts is their confidence
bound nearest to 0, by the number of texts the feature is in. Every occurrence
of a word weighs as its feature of the strongest evidence, for or against; words
that do not speak for toxicity weigh ``DRIFT`` less, and end a passage.

A linear scan (all maximal-scoring subsequences) over a text's words finds every
passage whose weight cannot be raised by making it longer or shorter. Passage
scores follow an extreme-value law on texts that are not toxic, with the rate
that solves ``E exp(rate * weight) = 1`` there; it turns a score and the length
of the text into an expected number of chance passages. Passages below
``SIGNIFICANT`` are reported, and the best and the sum of their normalised
scores become a probability by a logistic curve.

* NULL, empty texts and texts without letters have no passage and get a score.
* Whole texts are scanned; equal rows get equal scores; an empty table gives an
  empty result.
* Ties at the threshold count as 1. Columns named like the results are replaced
  by them.
* The labelled sample is bounded by ``per_class`` texts of each class.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from seston.llm.common import fit_logistic, kept_for, labelled_sample, letter_words, logistic, over_texts

PER_CLASS = 1500
PREFIXES = (4, 5, 6, 7)
PRIOR = 50.0
BOUND = 3.0
#: texts that a feature must occur in; fewer cannot pass the bound
FEWEST = 4
DRIFT = 0.5
CACHE = 400_000
SIGNIFICANT = 0.01
THRESHOLD = 0.7


@dataclass
class Model:
    """Feature weights, the law of chance scores and the calibration curve."""

    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 0.1
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def key(self) -> tuple:
        return ("toxicity", hash(frozenset(self.weights.items())), self.rate, self.k, *self.curve)


@dataclass
class Found:
    score: float
    best: float
    passages: list[tuple[int, int, float, float]]


def features(word: bytes) -> list[str]:
    """The word and its leading parts (marked, so that they are not words)."""
    letters = word.decode("utf-8", "replace")
    return [letters] + [letters[:n] + "*" for n in PREFIXES if len(letters) > n]


class Weights(dict):
    """Weights of words, found once each and kept up to ``CACHE`` words."""

    def __init__(self, known: dict[str, float]):
        self._known = known

    def __missing__(self, word: bytes) -> float:
        evidence = max((self._known.get(f, 0.0) for f in features(word)), key=abs)
        self[word] = weight = evidence if evidence > 0 else evidence - DRIFT
        return weight

    def of(self, words: list[bytes]) -> list[float]:
        """The weight of every word of a text, each time it occurs."""
        if len(self) > CACHE:
            self.clear()
        return list(map(self.__getitem__, words))


@dataclass
class Counts:
    """Of every feature the texts that have it and its occurrences; the number
    of all texts and words."""

    texts: Counter = field(default_factory=Counter)
    places: Counter = field(default_factory=Counter)
    n: int = 0
    words: int = 0

    def __add__(self, other: Counts) -> Counts:
        return Counts(self.texts + other.texts, self.places + other.places, self.n + other.n, self.words + other.words)


def log_odds(toxic: Counts, other: Counts) -> dict[str, float]:
    """Features whose log-odds are ``BOUND`` standard deviations above or below
    0, less these deviations. A text that repeats a feature is one witness."""
    found = {}
    na, nb, n = max(1, toxic.words), max(1, other.words), max(1, toxic.n + other.n)
    mass = PRIOR * (na + nb) / n  # the words of PRIOR texts
    for f in toxic.texts.keys() | other.texts.keys():
        y, z = toxic.places[f], other.places[f]
        prior = mass * (y + z) / (na + nb)
        up = math.log((y + prior) / (na + mass - y - prior + 1e-9))
        down = math.log((z + prior) / (nb + mass - z - prior + 1e-9))
        y, z = toxic.texts[f], other.texts[f]
        prior = PRIOR * (y + z) / n
        bound = BOUND * math.sqrt(1 / (y + prior) + 1 / (z + prior))
        if abs(up - down) > bound:
            found[f] = math.copysign(abs(up - down) - bound, up - down)
    return found


def frequent(texts: list[str]) -> set[str]:
    """Features that are in at least ``FEWEST`` texts."""
    met: Counter = Counter()
    for t in texts:
        met.update({f for w in set(letter_words(t)) for f in features(w)})
    return {f for f, n in met.items() if n >= FEWEST}


def occurrences(texts: list[str], only: set[str]) -> Counts:
    counts = Counts()
    for t in texts:
        words = letter_words(t)
        places: Counter = Counter()
        for w, n in Counter(words).items():
            for f in features(w):
                if f in only:
                    places[f] += n
        counts.texts.update(places.keys())
        counts.places.update(places)
        counts.n += 1
        counts.words += len(words)
    return counts


def maximal_passages(
    at: list[int], weight: list[float], drift: float = DRIFT, between: list[float] | None = None
) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs (first word, last word, score) of a text whose
    words weigh ``-drift`` except those at ``at``; or, if ``between`` is given,
    that much in all between each of these and the one before.

    One pass over the positive words. Each candidate holds the sums before and
    after it; a new one is joined to the nearest earlier candidate that begins
    lower and ends lower, together with all between.
    """
    runs: list[list[float]] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for k, (i, w) in enumerate(zip(at, weight, strict=True)):
        total += between[k] if between is not None else -drift * (i - last - 1)
        new = [i, i, total, total + w]
        total += w
        last = i
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= new[2]:
                j -= 1
            if j < 0 or runs[j][3] >= new[3]:
                runs.append(new)
                break
            new = [runs[j][0], new[1], runs[j][2], new[3]]
            del runs[j:]
    return [(int(r[0]), int(r[1]), r[3] - r[2]) for r in runs]


class Scorer:
    def __init__(self, model: Model):
        self._m, self._weights = model, Weights(model.weights)

    def runs(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words and the maximal passages in words."""
        words = letter_words(text)
        weights = np.array(self._weights.of(words))
        at = np.flatnonzero(weights > 0)
        if not len(at):
            return len(words), []
        after = np.cumsum(weights)[at]
        between = np.diff(after, prepend=0.0) - weights[at]
        return len(words), maximal_passages(at.tolist(), weights[at].tolist(), between=between.tolist())

    def measured(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int, float, float]]]:
        """Best and summed normalised score, and the significant passages."""
        n, runs = self.runs(text)
        if not runs:
            return np.zeros(2), []
        floor = math.log(self._m.k * n)
        passages = []
        for first, last, s in runs:
            expected = math.exp(min(50.0, floor - self._m.rate * s))
            if expected < SIGNIFICANT:
                passages.append((first, last, s, -math.expm1(-expected)))
        best = max(0.0, self._m.rate * max(r[2] for r in runs) - floor)
        every = sum(self._m.rate * p[2] - floor for p in passages)
        return np.array([math.tanh(best / 5), math.log1p(every)]), passages

    def __call__(self, text: str | None) -> Found:
        x, passages = self.measured(text)
        return Found(float(logistic(self._m.curve, x[None])[0]), float(x[0]), passages)


def train(sample: list[tuple[str, int]]) -> Model:
    """Weights of two crossed halves calibrate, weights of all texts score."""
    sample = list(dict.fromkeys(sample))
    kind = {v: [t for t, y in sample if y == v] for v in (0, 1)}
    if not kind[0] or not kind[1]:
        model = Model()
        model.curve[0] = math.log((len(kind[1]) + 1) / (len(kind[0]) + 1))
        return model
    enough = frequent(kind[0] + kind[1])
    met = [[occurrences(kind[v][h::2], enough) for v in (0, 1)] for h in (0, 1)]
    x, y = [], []
    for half in (0, 1):
        part = Model(log_odds(met[half][1], met[half][0]))
        law(part, kind[0][half::2])
        scorer = Scorer(part)
        for v in (0, 1):
            for t in kind[v][1 - half :: 2]:
                x.append(scorer.measured(t)[0])
                y.append(v)
    model = Model(log_odds(met[0][1] + met[1][1], met[0][0] + met[1][0]))
    law(model, kind[0])
    fitted = fit_logistic(np.array(x), np.array(y), ridge=1e-4)
    model.curve[: len(fitted)] = fitted
    return model


def law(model: Model, others: list[str]) -> None:
    """Rate and scale of chance scores, from texts that are not toxic."""
    weights, scorer, words = Weights(model.weights), Scorer(model), 0
    met: Counter = Counter()
    best = []
    for t in others:
        tokens = letter_words(t)
        words += len(tokens)
        met.update(weights.of(tokens))
    if not words:
        return
    values = np.array([*met, max([w for w in model.weights.values() if w > 0], default=1.0)])
    counts = np.array([*met.values(), 1.0])
    mean = lambda r: (counts * np.exp(np.minimum(r * values, 700))).sum() / counts.sum()
    low, high = 1e-6, 16.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if mean(mid) > 1 else (mid, high)
    model.rate = high
    for t in others:
        n, runs = scorer.runs(t)
        if n:
            best.append(math.exp(min(30.0, model.rate * max((r[2] for r in runs), default=0.0))) / n)
    # E = k n exp(-rate s) has the median log 2 over chance texts
    model.k = max(1e-6, math.log(2) * float(np.median(best))) if best else 0.1


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, prefix: str = "", keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless it is kept; adds ``score``, ``predicted`` and ``passages``
    (first and last word, counted from 0 among the text's words of letters,
    score, p)."""
    kind = pa.list_(
        pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p", pa.float64())])
    )

    def make():
        scorer = kept_for(model.key(), lambda: Scorer(model))

        def work(texts: list) -> dict[str, pa.Array]:
            found = [scorer(t) for t in texts]
            passages = [[dict(zip(("first", "last", "score", "p"), p, strict=True)) for p in f.passages] for f in found]
            return {
                f"{prefix}score": pa.array([f.score for f in found], pa.float64()),
                f"{prefix}predicted": pa.array([int(f.score >= threshold) for f in found], pa.int32()),
                f"{prefix}passages": pa.array(passages, kind),
            }

        return work

    added = (
        f"{prefix}score double, {prefix}predicted int, "
        f"{prefix}passages array<struct<first:int,last:int,score:double,p:double>>"
    )
    return over_texts(docs, text, make, added, keep_text)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS, label: str = "toxic") -> Model:
    return train(labelled_sample(docs, labels, label, learn_from, per_class))

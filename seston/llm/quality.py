"""Quality classifier: compression against dictionaries of good and bad text.

A zstandard dictionary is built from good and one from bad labelled text. A
text is cut into pieces (all of it), each piece is compressed with either
dictionary, and the difference of the summed sizes over their sum is taken.
The same is done for the shape of the text (letters and digits replaced by
their kind), which shows layout and marks whatever the language. A logistic
curve over both differences gives a probability. It is fitted on labelled texts
that were not in the dictionaries they are measured with (two halves, crosswise).

* NULL and empty texts have the difference 0 and get the score of 0.
* Texts of any length are scored whole; memory holds a slice of a batch.
* Repeated rows get equal scores; an empty table gives an empty result.
* Ties at the threshold count as 1. Columns named like the results are replaced
  by them.
* Without labelled texts of both classes the score is the smoothed share of
  good labels for every text.
* The labelled sample is bounded by ``per_class`` texts of each class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.llm.common import fit_logistic, labelled_sample, logistic, over_texts

PIECE = 1024
DICTIONARY = 64 * 1024
LEVEL = 3
#: relative difference of sizes beyond which more difference says little more
EVEN = 0.03
PER_CLASS = 1500
THRESHOLD = 0.7


#: kinds of bytes: lower-case letter, capital, digit, part of a longer character
SHAPE = bytes(
    ord("0") if c in b"0123456789" else ord("A") if 65 <= c <= 90 else ord("a") if c >= 97 and (c <= 122 or c >= 128) else c
    for c in range(256)
)
LATER_BYTES = bytes(range(0x80, 0xC0))


@dataclass
class Model:
    """For the text and for its shape: the dictionaries (raw bytes) of good and
    bad text. And the calibration curve."""

    dictionaries: list[tuple[bytes, bytes]]
    curve: np.ndarray


def views(text: str | None) -> tuple[bytes, bytes]:
    """The bytes of a text and of its shape."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data, data.translate(SHAPE, LATER_BYTES)


def pieces(data: bytes, size: int = PIECE) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def build_dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; the end of the joined text where there is too
    little of it to train on."""
    samples = [p for t in texts for p in pieces(t) if p]
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[-size:]


class Measure:
    """Relative differences of the compressed sizes of a text and its shape."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]]):
        self._pairs = [[self._loaded(d) for d in pair] for pair in dictionaries]

    @staticmethod
    def _loaded(data: bytes) -> zstandard.ZstdCompressor:
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if len(data) < 8:
            return zstandard.ZstdCompressor(**options)
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=dictionary, **options)

    def __call__(self, text: str | None) -> list[float]:
        found = []
        for data, pair in zip(views(text), self._pairs, strict=True):
            parts = pieces(data)
            good, bad = (sum(len(c.compress(p)) for p in parts) for c in pair)
            found.append(math.tanh((bad - good) / (bad + good) / EVEN) if parts else 0.0)
        return found


def dictionaries(good: list[str], bad: list[str]) -> list[tuple[bytes, bytes]]:
    seen = [[views(t) for t in texts] for texts in (good, bad)]
    return [tuple(build_dictionary([v[k] for v in side]) for side in seen) for k in (0, 1)]


def train(sample: list[tuple[str, int]]) -> Model:
    """Dictionaries of all sampled texts, curve from two crossed halves."""
    texts = {v: [t for t, y in sample if y == v] for v in (0, 1)}
    x, y = [], []
    for half in (0, 1):
        measure = Measure(dictionaries(texts[1][half::2], texts[0][half::2]))
        for v in (0, 1):
            for t in texts[v][1 - half :: 2]:
                x.append(measure(t))
                y.append(v)
    curve = np.zeros(3)
    fitted = fit_logistic(np.array(x, float).reshape(len(x), 2), np.array(y, float), ridge=1e-5)
    curve[: len(fitted)] = fitted
    return Model(dictionaries(texts[1], texts[0]), curve)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, prefix: str = "", keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless it is kept, with ``score`` and ``predicted``."""

    def make():
        measure = Measure(model.dictionaries)

        def work(texts: list) -> dict[str, pa.Array]:
            p = logistic(model.curve, np.array([measure(t) for t in texts], float).reshape(len(texts), 2))
            return {
                f"{prefix}score": pa.array(p, pa.float64()),
                f"{prefix}predicted": pa.array((p >= threshold).astype("int32"), pa.int32()),
            }

        return work

    return over_texts(docs, text, make, f"{prefix}score double, {prefix}predicted int", keep_text)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS, label: str = "quality") -> Model:
    return train(labelled_sample(docs, labels, label, learn_from, per_class))

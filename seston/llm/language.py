"""Language identification by cross-parsing.

For every language a suffix automaton of its labelled words answers how far a
text can be matched as a piece of that language. A text is cut greedily into
the longest such pieces; phrases end at word ends, so the number of a word is
found once and kept. The language that needs the fewest phrases, normalised by
what unseen text of the language itself needs, wins.

* Only letters count (see ``letter_words``), over the whole text.
* NULL, empty texts and texts without letters are ``und`` with score 0. So is
  every text if nothing was learned.
* Ties go to the language first in code point order. Equal rows get equal
  results; an empty table gives an empty result. Columns named like the results
  are replaced by them.
* Learning is bounded by ``PER_LANGUAGE`` texts and ``LETTERS`` bytes of
  distinct words of each language. A language of one labelled text is measured
  like the others, with the mean of all where its text does not suffice.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seston.llm.common import kept_for, letter_words, over_texts

PER_LANGUAGE = 400
LETTERS = 60_000
#: bytes of text below which a language's own norm counts less than that of all
SHRINK = 20_000
CACHE = 400_000
UNKNOWN = "und"


class SuffixAutomaton:
    """The smallest automaton of all substrings of a byte string."""

    def __init__(self, data: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in data:
            new = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def phrases(self, data: bytes) -> int:
        """Fewest pieces of the string, or single foreign bytes, that make up
        ``data``: longest matches from left to right."""
        step, at, state, started = self.next, 0, 0, False
        count = 0
        for c in data:
            to = step[state].get(c)
            if to is None:
                count += started
                to = step[0].get(c)
                if to is None:
                    count += 1
                    state, started = 0, False
                    continue
            state, started = to, True
        return count + started


def train(samples: dict[str, list[str]], letters: int = LETTERS) -> dict[str, tuple[bytes, float]]:
    """For every language its words as one string and the phrases per byte
    that unseen text of the language needs.

    The running words of all its texts are halved and parsed crosswise, so one
    text is enough to measure. Halves of little text know too few words and
    need too many phrases, so the figure is drawn to that of all languages
    together as if ``SHRINK`` bytes of each had been measured there."""
    words, measured = {}, {}
    for lang in sorted(samples):
        running = [w for t in dict.fromkeys(samples[lang]) for w in letter_words(t)]
        if not running:
            continue
        words[lang] = joined(running, letters)
        halves = running[: len(running) // 2], running[len(running) // 2 :]
        needed = size = 0
        for known, unseen in (halves, halves[::-1]):
            auto = SuffixAutomaton(joined(known, letters // 2))
            for word, n in Counter(unseen).items():
                needed += n * auto.phrases(b" " + word + b" ")
                size += n * (len(word) + 1)
        measured[lang] = (needed, size)
    total = sum(s for _, s in measured.values())
    mean = sum(n for n, _ in measured.values()) / total if total else 1.0
    return {x: (words[x], (n + SHRINK * mean) / (s + SHRINK)) for x, (n, s) in measured.items() if words[x].strip()}


def joined(words: list[bytes], letters: int) -> bytes:
    """Distinct words between blanks, the most frequent first."""
    out, total = [], 0
    for w, _ in sorted(Counter(words).items(), key=lambda x: (-x[1], x[0])):
        total += len(w) + 1
        if total > letters:
            break
        out.append(w)
    return b" " + b" ".join(out) + b" "


class Parser:
    def __init__(self, model: dict[str, tuple[bytes, float]]):
        self.langs = sorted(model)
        self._autos = [SuffixAutomaton(model[x][0]) for x in self.langs]
        self._norm = np.array([model[x][1] for x in self.langs])
        self._index: dict[bytes, int] = {}
        self._counts = np.zeros((4096, len(self.langs) + 1), np.int32)

    def _add(self, word: bytes) -> int:
        i = len(self._index)
        if i == len(self._counts):
            self._counts = np.concatenate([self._counts, np.zeros_like(self._counts)])
        padded = b" " + word + b" "
        self._counts[i] = [a.phrases(padded) for a in self._autos] + [len(word) + 1]
        self._index[word] = i
        return i

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = letter_words(text)
        if not words or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self._index) > CACHE:
            self._index.clear()
        get, add = self._index.get, self._add
        rows = [i if (i := get(w)) is not None else add(w) for w in words]
        sums = self._counts[rows].sum(0, dtype=np.int64)
        cost = sums[:-1] / self._norm / sums[-1]
        best = int(cost.argmin())
        # how much the others need above the best, over the length of the text
        above = (cost - cost[best]) * np.sqrt(len(words))
        return self.langs[best], float(1 / np.exp(-np.minimum(above, 700)).sum())


def sample(docs: DataFrame, learn_from: Column, doc_id: str, text: str, lang: str, per_language: int) -> dict[str, list[str]]:
    """At most ``per_language`` whole texts of each language, in hash order of
    their ids. Ids are chosen by one count-bounded window per language over a
    hash range that is narrowed first, so that a language with a third of all
    rows is not put in order by one task. What is broadcast is one count per
    language; there are as many languages as automata fit a task."""
    known = docs.where(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        doc_id, lang, F.xxhash64(doc_id).alias("_order")
    )
    # keep, in each language, the hash range that is expected to hold four times what is needed
    sizes = known.groupBy(lang).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("_n"))
    narrowed = known.join(F.broadcast(sizes), lang).where((F.shiftrightunsigned("_order", 11) / float(1 << 53)) <= share)
    first = Window.partitionBy(lang).orderBy("_order", doc_id)
    chosen = narrowed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language)
    chosen = chosen.select(doc_id, "_order").distinct()
    rows = docs.where(learn_from).select(doc_id, text, lang).join(F.broadcast(chosen), doc_id).select("_order", text, lang).collect()
    out: dict[str, list[str]] = {}
    for _, t, x in sorted(((r[0], r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None)):
        out.setdefault(x, []).append(t)
    return out


def identify(docs: DataFrame, model: dict[str, tuple[bytes, float]], text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` without the text; adds ``lang_pred`` and ``score``."""
    key = ("language", *((x, hashlib.sha256(m[0]).hexdigest(), m[1]) for x, m in sorted(model.items())))

    def make():
        parser = kept_for(key, lambda: Parser(model))

        def work(texts: list) -> dict[str, pa.Array]:
            found = [parser(t) for t in texts]
            return {
                f"{prefix}lang_pred": pa.array([f[0] for f in found], pa.string()),
                f"{prefix}score": pa.array([f[1] for f in found], pa.float64()),
            }

        return work

    return over_texts(docs, text, make, f"{prefix}lang_pred string, {prefix}score double")


def learn(
    docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> dict[str, tuple[bytes, float]]:
    return train(sample(docs, learn_from, doc_id, text, lang, per_language))

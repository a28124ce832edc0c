"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is normalised and cut into words as the vocabulary file says; a word is
the sequence of its bytes, the last one marked as the end. Over the word stands
a segment tree whose leaf i holds (rank, i) of the pair that begins at i. Its
root is the leftmost pair of lowest rank: the next merge. A merge changes three
leaves, each carried up in as many steps as the tree has levels, and the word is
done when the root holds no pair. Words of like length that a task has not met
yet are merged in step, one merge of every word at a time, as rows of one array
of trees; a few long ones are merged one by one.

* NULL text gives NULL results, empty text gives no ids and decodes to ``""``.
* The strings of special tokens in a text are those tokens, as in the file.
* Equal ranks: the leftmost pair goes first. Equal rows get equal ids.
* Whole texts of any length; ``CACHE`` bounds the words a task remembers.
* An empty table gives an empty result. Columns of the input are passed through;
  one named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seston.llm.common import kept_for, over_texts

MODEL = "/opt/tokenizers/word_bpe_49k.json"
CACHE = 400_000
#: words merged in step, and the fewest for which that is worth while
ROWS, FEW = 4096, 8
NONE = np.int64(2**62)


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Model:
    """Normalisation, word pattern, vocabulary and merges of a file."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        said = json.loads(data)
        model = said["model"]
        steps = [n.get("type") for n in (said["normalizer"] or {}).get("normalizers", [])]
        cuts = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = model["type"] == "BPE" and model["end_of_word_suffix"] and not said["decoder"] and not model["dropout"]
        if not known or steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            raise ValueError("only byte-level vocabularies with word ends, NFC and lower case are supported")
        self._library = Tokenizer.from_str(data.decode())
        self._pattern = regex.compile(cuts[0]["pattern"]["Regex"])
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        signs = byte_signs()
        self._byte_of = {s: b for b, s in enumerate(signs)}
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.special = special
        self._special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(special, key=len, reverse=True)) or "(?!)")
        self.names: dict[int, str] = {i: t for t, i in (vocab | special).items()}
        left, right, to = [], [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            to.append(vocab[a + b])
        self.to = np.array(to, np.int64)
        self._base = np.int64(max(vocab.values()) + 2)
        keys = np.array(left, np.int64) * self._base + np.array(right, np.int64)
        self._order = np.argsort(keys, kind="stable")
        self._keys = np.append(keys[self._order], NONE)
        self._order = np.append(self._order, 0)
        self.rank_of = dict(zip(zip(left, right, strict=True), range(len(to)), strict=True))
        # characters that this Python's tables do not know are left to the library
        missing = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
        runs = np.split(missing, np.flatnonzero(np.diff(missing) != 1) + 1)
        self._unknown = re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]")
        self._high = re.compile(f"[{chr(missing[0])}-{chr(sys.maxunicode)}]+")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where it cannot be merged; id -1 has no pairs."""
        key = a * self._base + b
        at = np.searchsorted(self._keys, key)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._order[at], NONE)

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            if self._unknown.search("".join(self._high.findall(text))):
                lib = self._library
                cut = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
                return [bytes(map(self._byte_of.__getitem__, w)).decode() for w, _ in cut]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self._pattern.findall(text.lower())


class Encoder:
    def __init__(self, data: bytes):
        self.model = Model(data)
        self._known: dict[str, list[int]] = {}
        self._older: dict[str, list[int]] = {}

    def merge_one(self, ids: list[int]) -> list[int]:
        """Merge one word by a segment tree in lists."""
        n, rank_of, to = len(ids), self.model.rank_of, self.model.to
        none = (len(to), 0)
        size = 1 << max(0, n - 1).bit_length()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        leaf = [(rank_of.get((ids[i], ids[i + 1]), len(to)), i) for i in range(n - 1)]
        tree = [none] * size + leaf + [none] * (size - n + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int | None) -> None:
            at = size + i
            tree[at] = none if rank is None else (rank, i)
            while at > 1:
                at >>= 1
                best = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == best:
                    break
                tree[at] = best

        gone = set()
        while size > 1 and tree[1][0] < len(to):
            rank, i = tree[1]
            j = after[i]
            ids[i] = int(to[rank])
            gone.add(j)
            after[i] = after[j]
            put(j, None)
            put(i, rank_of.get((ids[i], ids[after[i]])) if after[i] < n else None)
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                put(before[i], rank_of.get((ids[before[i]], ids[i])))
        return [x for i, x in enumerate(ids) if i not in gone]

    def merge_in_step(self, words: list[bytes], size: int) -> list[list[int]]:
        """Merge words of at most ``size`` bytes, a power of two, one merge of
        each word at a time. A row of ``tree`` is the segment tree of a word:
        node 1 the root, nodes 2k and 2k + 1 below node k, leaves from ``size``."""
        w, model = len(words), self.model
        lengths = np.fromiter(map(len, words), np.int64, w)
        inside = np.arange(size) < lengths[:, None]
        codes = np.zeros((w, size), np.int64)
        codes[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((w, size + 1), -1, np.int64)
        ids[:, :size][inside] = model.inner[codes[inside]]
        ends = (np.arange(w), lengths - 1)
        ids[ends] = model.last[codes[ends]]
        alive = inside
        after = np.broadcast_to(np.arange(1, size + 2), (w, size + 1)).copy()
        after[:, :size][after[:, :size] >= lengths[:, None]] = size
        after[:, size] = size
        before = np.broadcast_to(np.arange(-1, size), (w, size + 1)).copy()
        tree = np.full((w, 2 * size), NONE, np.int64)
        rank = model.ranks(ids[:, :size], np.take_along_axis(ids, after[:, :size], 1))
        tree[:, size:] = np.where(rank < NONE, rank * size + np.arange(size), NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        flat_ids, flat_after, flat_before, flat_alive, flat_tree = ids.ravel(), after.ravel(), before.ravel(), alive.ravel(), tree.ravel()
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            top = flat_tree[rows * (2 * size) + 1]
            i = top % size
            o = rows * (size + 1)
            j = flat_after[o + i]
            new = model.to[top // size]
            k = flat_after[o + j]
            h = flat_before[o + i]
            h = np.where(h < 0, i, h)
            flat_ids[o + i] = new
            flat_after[o + i] = k
            flat_before[o + k] = i
            flat_alive[rows * size + j] = False
            right = model.ranks(new, flat_ids[o + k])
            left = model.ranks(flat_ids[o + h], new)
            t = rows * (2 * size)
            at = np.stack([size + j, size + h, size + i])
            flat_tree[t + at[0]] = NONE
            flat_tree[t + at[1]] = np.where(left < NONE, left * size + h, NONE)
            flat_tree[t + at[2]] = np.where(right < NONE, right * size + i, NONE)
            for _ in range(size.bit_length() - 1):
                at >>= 1
                flat_tree[t + at] = np.minimum(flat_tree[t + 2 * at], flat_tree[t + 2 * at + 1])
            rows = rows[flat_tree[t + 1] < NONE]
        ends = np.cumsum(alive.sum(1))[:-1].tolist()
        flat = ids[:, :size][alive].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], [*ends, len(flat)], strict=True)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that are not empty, each merged by itself."""
        data = [w.encode() for w in words]
        sizes: dict[int, list[int]] = {}
        for n, w in enumerate(data):
            sizes.setdefault(1 << (len(w) - 1).bit_length(), []).append(n)
        out: list[list[int]] = [[]] * len(words)
        for size, which in sizes.items():
            step = max(FEW, min(ROWS, (1 << 20) // size))
            for s in range(0, len(which), step):
                part = which[s : s + step]
                if size == 1:
                    found = [[int(self.model.last[data[n][0]])] for n in part]
                elif len(part) < FEW:
                    inner, last = self.model.inner, self.model.last
                    found = [self.merge_one([*inner[list(data[n][:-1])].tolist(), int(last[data[n][-1]])]) for n in part]
                else:
                    found = self.merge_in_step([data[n] for n in part], size)
                for n, ids in zip(part, found, strict=True):
                    out[n] = ids
        return out

    def cut(self, text: str) -> list[str]:
        """Words of a text and, as they stand, its special tokens."""
        out = []
        for i, part in enumerate(self.model._special.split(text)):
            if part:
                if part in self.model.special and i % (len(self.model.special) + 1):
                    out.append("\0" + part)
                else:
                    out += self.model.words(part)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of every text; words that are new in them are merged together."""
        special = self.model.special
        marked = lambda t: any(s in t for s in special)
        cut = [None if t is None else self.cut(t) if marked(t) else self.model.words(t) for t in texts]
        if len(self._known) > CACHE // 2:  # what is not met again is forgotten
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        new = []
        for w in set(chain.from_iterable(c for c in cut if c)).difference(known):
            if w in older:
                known[w] = older[w]
            elif w[0] == "\0" and w[1:] in special:
                known[w] = [special[w[1:]]]
            else:
                new.append(w)
        known.update(zip(new, self.encode_words(new), strict=True))
        get = known.__getitem__
        return [None if c is None else np.fromiter(chain.from_iterable(map(get, c)), np.int32) for c in cut]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.model.names.__getitem__, ids))


def loaded(model: str | bytes) -> tuple[bytes, tuple]:
    """The bytes of a model and a key for what is built from them."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    return model, ("bpe", hashlib.sha256(model).hexdigest())


def encode(docs: DataFrame, text: str = "text", model: str | bytes = MODEL) -> DataFrame:
    """``docs`` without the text; adds ``ids``, ``n_tokens`` and ``decoded``,
    the text that the ids give back. ``model`` is a path the session's driver
    can read, or the file's content; tasks get its bytes."""
    docs = docs.drop(*[c for c in docs.columns if c != text and c.lower() in ("ids", "n_tokens", "decoded")])
    model, key = loaded(model)

    def make():
        encoder = kept_for(key, lambda: Encoder(model))

        def work(texts: list) -> dict[str, pa.Array]:
            ids = encoder.encode(texts)
            return {
                "ids": pa.array(ids, pa.list_(pa.int32())),
                "n_tokens": pa.array([None if i is None else len(i) for i in ids], pa.int64()),
                "decoded": pa.array([None if i is None else encoder.decode(i.tolist()) for i in ids], pa.string()),
            }

        return work

    return over_texts(docs, text, make, "ids array<int>, n_tokens bigint, decoded string")


def decode(tokens: DataFrame, ids: str = "ids", model: str | bytes = MODEL) -> DataFrame:
    """``tokens`` without ``ids``; adds ``decoded``. NULL ids give NULL."""
    tokens = tokens.drop(*[c for c in tokens.columns if c != ids and c.lower() == "decoded"])
    model, key = loaded(model)
    kept = [c for c in tokens.columns if c != ids]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != ids] + ["decoded string"])

    def run(batches):
        encoder = kept_for(key, lambda: Encoder(model))
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], [*kept, "decoded"])

    return tokens.mapInArrow(run, schema)

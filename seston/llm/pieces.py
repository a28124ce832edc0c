"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece can cross: before a run of blanks that follows
something else. The parts that a task has not met yet are joined into one
string; its suffix array gives the occurrences of every piece by binary search,
one character of all pieces at a time. The occurrences, as edges sorted by
position, are then relaxed from left to right, in all parts at a time.

For a byte-pair model an edge is taken if its piece and the piece before it
stay apart when the two are merged by the model's own rules; this holds for all
neighbours of exactly one path, the model's segmentation. For a unigram model
the path with the best sum of scores is taken.

* NULL text gives NULL ids and NULL counts; empty text gives no ids.
* Characters without a piece become bytes; if the model has no bytes, ``<unk>``.
* Decoding gives the text back, but for the blank sign U+2581, which means a
  blank, and for ``<unk>``.
* Whole texts of any length; equal rows get equal ids; an empty table gives an
  empty result. ``CACHE`` bounds the parts a task remembers.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seston.llm.common import kept_for, over_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CACHE = 500_000
AT_ONCE = 400_000
#: so few parts are encoded one by one
TOGETHER = 100
NORMAL, UNKNOWN, BYTE = 1, 2, 6


class Model:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        norm = proto.normalizer_spec
        if norm.name not in ("identity", "") or norm.remove_extra_whitespaces:
            raise ValueError("only models that leave text as it is are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.merges = proto.trainer_spec.model_type == 2
        self.text, self.score, self.id = [], [], {}
        self.unknown, self.bytes = 0, {}
        self.out: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            self.text.append(p.piece)
            self.score.append(p.score)
            if p.type == NORMAL:
                self.id[p.piece] = i
                self.out.append(p.piece.replace(BLANK, " ").encode())
            elif p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.out.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.out.append(" ⁇ ".encode() if p.type == UNKNOWN else b"")
                self.unknown = i if p.type == UNKNOWN else self.unknown
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.id)
        lines = any("\n" in p for p in self.id)
        # for texts with blanks in place of blank signs
        if crossing:
            self.parts = re.compile("(?s).+")
        elif lines:
            self.parts = re.compile("(?s) +[^ ]*|[^ ]+")
        else:
            marks = self.never_after_letters()
            ended = f" *[^\\W\\d_]+(?=[{marks}])|" if marks else ""
            self.parts = re.compile(f"\n|{ended} +[^ \n]*|[^ \n]+")

    def never_after_letters(self) -> str:
        """ASCII marks that follow a letter in no piece: a word ends there."""
        follow = {y for p in self.id for x, y in zip(p, p[1:], strict=False) if x.isalpha()}
        return "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_" and c not in follow)

    def fallback(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode()]


class Matcher:
    """Occurrences of all pieces in a text, through its suffix array."""

    def __init__(self, model: Model):
        # the longest first, so that occurrences come in this order
        texts = sorted(model.id, key=len, reverse=True)
        self._ids = np.array([model.id[t] for t in texts], np.int64)
        self._length = np.array([len(t) for t in texts])
        self.width = int(self._length.max())
        self._codes = np.zeros((len(texts), self.width), np.int64)
        for i, t in enumerate(texts):
            self._codes[i, : len(t)] = [ord(c) for c in t]

    def suffix_array(self, codes: np.ndarray) -> np.ndarray:
        """Positions in the order of the ``width`` characters that follow; more
        than the longest piece is never looked at."""
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
        h = 1
        while h < self.width:
            after = np.zeros_like(rank)
            after[:-h] = rank[h:]
            rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            h *= 2
        return np.argsort(rank, kind="stable")

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, piece id and length of every occurrence, by position, the
        longest first."""
        array = self.suffix_array(codes)
        padded = np.concatenate([codes, np.zeros(self.width + 1, codes.dtype)])
        low = np.zeros(len(self._ids), np.int64)
        high = np.full(len(self._ids), len(codes), np.int64)
        for step in range(self.width):
            live = np.flatnonzero((self._length > step) & (low < high))
            if not len(live):
                break
            want = self._codes[live, step]
            for side in (0, 1):
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    at = padded[array[np.minimum(mid, len(array) - 1)] + step]
                    less = (at < want) if side == 0 else (at <= want)
                    a = np.where(open_ & less, mid + 1, a)
                    b = np.where(open_ & ~less, mid, b)
                if side == 0:
                    first = a
                else:
                    last = a
            low[live], high[live] = first, last
        found = np.flatnonzero(low < high)
        count = (high - low)[found]
        start = np.repeat(low[found] - np.cumsum(count) + count, count)
        at = array[start + np.arange(count.sum())]
        which = np.repeat(found, count)
        order = np.argsort(at * (self.width + 1) - self._length[which])
        return at[order], self._ids[which][order], self._length[which][order]


class Encoder:
    def __init__(self, data: bytes):
        self.model = Model(data)
        self._matcher = Matcher(self.model)
        #: ids of parts, as bytes of 32-bit numbers
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: by the piece before (None: at the begin of a part), then by the piece
        self._apart: dict[int | None, dict[int, bool]] = {}
        self._pairs = 0
        #: the same as sorted keys, and what was found since they were sorted
        self._keys, self._answers = np.array([-1]), np.array([False])
        self._fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def merged(self, text: str) -> list[str]:
        """Segmentation of a short text by merging its best pair of neighbours,
        the leftmost of equal ones, until none can be merged."""
        parts, ids, score = list(text), self.model.id, self.model.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or score[j] > best):
                    best, at = score[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def name(self, piece: int) -> str:
        return self.model.text[piece] if piece >= 0 else chr(-piece)

    def apart(self, a: int | None, b: int) -> bool:
        """Whether piece b can follow piece a (None: begin a part)."""
        row = self._apart.setdefault(a, {})
        known = row.get(b)
        if known is None:
            left, right = [] if a is None else [self.name(a)], self.name(b)
            known = row[b] = self.merged("".join(left) + right) == left + [right]
            self._pairs += 1
        return known

    def all_apart(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """``apart`` of many pairs; -1 for the begin of a part."""
        n = len(self.model.text)
        keys = (before + 1) * n + pieces
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        answers = self._answers[at]
        missed = np.flatnonzero(self._keys[at] != keys)
        if len(missed):
            new, where = np.unique(keys[missed], return_inverse=True)
            pairs = zip((new // n).tolist(), (new % n).tolist(), strict=True)
            found = np.array([self.apart(a - 1 if a else None, b) for a, b in pairs])
            answers[missed] = found[where]
            self._fresh.append((new, found))
        return answers

    def sort_pairs(self) -> None:
        """Takes what was found into the sorted keys, once it is worth the sort."""
        if sum(len(k) for k, _ in self._fresh) > len(self._keys) // 20:
            keys = np.concatenate([self._keys, *[k for k, _ in self._fresh]])
            answers = np.concatenate([self._answers, *[a for _, a in self._fresh]])
            self._keys, first = np.unique(keys, return_index=True)
            self._answers, self._fresh = answers[first], []

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        joined = ("\0".join(parts) + "\0").replace(" ", BLANK)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        at, ids, length = self._matcher.edges(codes)
        begin = np.searchsorted(at, np.arange(len(codes) + 1))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        stop = np.cumsum(sizes + 1) - 1
        start = stop - sizes
        out = [None] * len(parts)
        if self.model.merges and len(parts) > TOGETHER:
            out = self.kept_apart_together(start, stop, begin, ids, length)
        rest = [k for k, found in enumerate(out) if found is None]
        if rest:
            begin, ids, length = begin.tolist(), ids.tolist(), length.tolist()
        for k in rest:
            found = self.relax(parts[k].replace(" ", BLANK), int(start[k]), begin, ids, length)
            out[k] = np.array(found, np.int32).tobytes()
        return out

    def kept_apart_together(
        self, start: np.ndarray, stop: np.ndarray, begin: np.ndarray, ids: np.ndarray, length: np.ndarray
    ) -> list[bytes | None]:
        """``kept_apart`` for all parts, an edge of each at a time. A position is
        entered once at most, so the path is kept by position. None for parts
        with a character without a piece, and for the last ones on the way."""
        size = int(stop[-1]) + 1
        piece, back = np.full(size + 1, -1), np.zeros(size + 1, np.int64)
        dead, tried = np.zeros(size + 1, bool), begin.copy()
        single = begin[1:] > begin[:-1]
        single[single] = length[begin[1:][single] - 1] == 1
        without = np.r_[0, np.cumsum(~single)]
        live = np.flatnonzero(without[start] == without[stop])
        pos, first, last = start[live], start[live], stop[live]
        done = np.zeros(len(start), bool)
        while len(live) > TOGETHER:
            e = tried[pos]
            tried[pos] = e + 1
            left = e < begin[pos + 1]
            e = np.minimum(e, len(ids) - 1)
            to = np.minimum(pos + length[e], size)
            go = np.flatnonzero(left & (to <= last) & ~dead[to])
            go = go[self.all_apart(piece[pos[go]], ids[e[go]])]
            over = np.flatnonzero(~left)
            new = pos.copy()
            new[go] = to[go]
            new[over] = back[pos[over]]
            piece[to[go]], back[to[go]] = ids[e[go]], pos[go]
            dead[pos[over]] = True
            done[live[new == last]] = True
            stay = new != last
            stay[over] &= pos[over] > first[over]
            live, pos, first, last = live[stay], new[stay], first[stay], last[stay]
        self.sort_pairs()
        taken = np.zeros(size + 1, bool)
        pos, first = stop[done], start[done]
        while len(pos):
            taken[pos] = True
            pos = back[pos]
            stay = pos > first
            pos, first = pos[stay], first[stay]
        data = piece[taken].astype(np.int32).tobytes()
        before = 4 * np.r_[0, np.cumsum(taken)]
        out: list[bytes | None] = [None] * len(start)
        for k, a, b in zip(np.flatnonzero(done).tolist(), before[start[done]].tolist(), before[stop[done] + 1].tolist(), strict=True):
            out[k] = data[a:b]
        return out

    def relax(self, part: str, o: int, begin: list[int], ids: list[int], length: list[int]) -> list[int]:
        """Ids of one part, from the edges that begin at its positions."""
        path = self.kept_apart if self.model.merges else self.best_sum
        fallback = self.model.fallback
        found = path(part, o, begin, ids, length)
        if min(found) >= 0:
            return found
        return list(chain.from_iterable([p] if p >= 0 else fallback(chr(-p)) for p in found))

    def kept_apart(self, part: str, o: int, begin: list[int], ids: list[int], length: list[int]) -> list[int]:
        """The path whose neighbours all stay apart. Longest edges are tried
        first; there is one such path to a position at most, so a position from
        which no edge leads on is not entered again."""
        n, apart = len(part), self._apart
        path, ends, tried = [], [0], [begin[o]]
        dead = set()
        before = None
        while ends[-1] < n:
            i = ends[-1]
            e, stop = tried[-1], begin[o + i + 1]
            row = apart.get(before) or apart.setdefault(before, {})
            while e < stop:
                ok = row.get(ids[e])
                if ok is None:
                    ok = self.apart(before, ids[e])
                if ok and (end := i + length[e]) <= n and end not in dead:
                    piece = ids[e]
                    break
                e += 1
            else:
                # a character without a piece is an edge of its own, tried last
                piece, end = -ord(part[i]), i + 1
                single = stop > begin[o + i] and length[stop - 1] == 1
                if single or e > stop or end in dead or not self.apart(before, piece):
                    dead.add(i)
                    ends.pop()
                    tried.pop()
                    path.pop()
                    before = path[-1] if path else None
                    continue
            tried[-1] = e + 1
            path.append(piece)
            ends.append(end)
            tried.append(begin[o + end])
            before = piece
        return path

    def best_sum(self, part: str, o: int, begin: list[int], ids: list[int], length: list[int]) -> list[int]:
        """The path with the best sum of scores; a character without a piece
        counts worse than any piece."""
        n, score = len(part), self.model.score
        none = min(score) - 10
        best = [0.0] + [float("-inf")] * n
        last, since = [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            single = False
            for e in range(begin[o + i], begin[o + i + 1]):
                end = i + length[e]
                single |= end == i + 1
                if end <= n and best[i] + score[ids[e]] > best[end]:
                    best[end], last[end], since[end] = best[i] + score[ids[e]], ids[e], i
            if not single and best[i] + none > best[i + 1]:
                best[i + 1], last[i + 1], since[i + 1] = best[i] + none, -ord(part[i]), i
        found, end = [], n
        while end > 0:
            found.append(last[end])
            end = since[end]
        return found[::-1]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of every text; what is new in them is matched together."""
        prefix = " " if self.model.dummy_prefix else ""
        cut = [None if t is None else self.model.parts.findall(prefix + t.replace(BLANK, " ")) if t else [] for t in texts]
        if len(self._known) > CACHE // 2:  # what is not met again is forgotten
            self._older, self._known = self._known, {}
        if self._pairs > CACHE:
            self._apart, self._pairs = {}, 0
            self._keys, self._answers, self._fresh = np.array([-1]), np.array([False]), []
        known, older = self._known, self._older
        new = []
        for p in dict.fromkeys(chain.from_iterable(c for c in cut if c)):
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        size, group = 0, []
        for p in [*new, None]:
            if p is None or (size + len(p) > AT_ONCE and group):
                if group:
                    known.update(zip(group, self.encode_parts(group), strict=True))
                size, group = 0, []
            if p is not None:
                group.append(p)
                size += len(p) + 1
        get = known.__getitem__
        return [None if c is None else np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]

    def decode(self, ids) -> str:
        text = b"".join(map(self.model.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, text: str = "text", model: str | bytes = MODEL) -> DataFrame:
    """``docs`` without the text; adds ``ids``, ``n_tokens`` and ``round_trip``
    (whether the ids decode to the text), in place of columns of these names. ``model`` is a path the session's
    driver can read, or the model itself; tasks get its bytes."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    key = ("pieces", hashlib.sha256(model).hexdigest())

    def make():
        encoder = kept_for(key, lambda: Encoder(model))

        def work(texts: list) -> dict[str, pa.Array]:
            ids = encoder.encode(texts)
            same = [
                None if t is None else encoder.decode(i.tolist()) == t.replace(BLANK, " ") for t, i in zip(texts, ids, strict=True)
            ]
            return {
                "ids": pa.array(ids, pa.list_(pa.int32())),
                "n_tokens": pa.array([None if i is None else len(i) for i in ids], pa.int64()),
                "round_trip": pa.array(same, pa.bool_()),
            }

        return work

    return over_texts(docs, text, make, "ids array<int>, n_tokens bigint, round_trip boolean")


def decode(tokens: DataFrame, ids: str = "ids", model: str | bytes = MODEL) -> DataFrame:
    """``tokens`` without ``ids``; adds ``text``, in place of a column of that
    name. NULL ids give NULL text."""
    tokens = tokens.drop(*[c for c in tokens.columns if c != ids and c.lower() == "text"])
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    kept = [c for c in tokens.columns if c != ids]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != ids] + ["text string"])
    key = ("pieces", hashlib.sha256(model).hexdigest())

    def run(batches):
        encoder = kept_for(key, lambda: Encoder(model))
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], [*kept, "text"])

    return tokens.mapInArrow(run, schema)

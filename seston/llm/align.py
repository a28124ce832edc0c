"""Alignment of the tokens of two tokenizers, in Arrow from end to end.

Tokenizer A is a byte-level BPE file, B a SentencePiece model; both see a blank
before the text. In a task, the token ids of many texts lie in two flat arrays;
parent indices name the text of each token and segmented cumulative sums of byte
lengths its end within the text. A hash join of both sides on (text, end) gives
all places where a token ends: those of both sides end a group, and each place
belongs to one token of A and one of B, so the places are the pairs of tokens
whose bytes overlap.

*Counts over the corpus.* Texts go through in blocks of some megabytes. A block
asks once for each pair of ids that it holds, with the number of its texts that
hold it; Spark sums these up and hands the sums back to the blocks that asked.
Links are not shuffled by pair, so no pair is a hot key: it is there once a block.

* NULL and empty texts, and texts that the joined bytes of A or B do not give
  back, have no tokens: all numbers are 0 and ``groups`` is ``""``.
* The strings of special tokens are plain text.
* A's best pairs are all those whose count ties for the highest. Repeated rows
  and equal texts count once each.
* Whole texts of any length; a text longer than a block is a block of its own.
  An empty table gives an empty result. Columns of the input are passed through;
  one named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.durable import Staged
from seston.llm.common import kept_for, slices

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: ids of ``MODEL_B``
SIZE_B = 32_000
BLANK = "▁"
#: fixed value: how the vocabulary of A cuts a text before it merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups", "block", "pairs", "times", "n_best", "count_sum")


class ByteBpe:
    """Encoding by a byte-level BPE file whose ids follow its merges."""

    def __init__(self, data: bytes):
        import tiktoken

        said = json.loads(data)
        cut = said["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        vocab = said["model"]["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in said["model"]["merges"]]
        if not plain or said["normalizer"] or merged != sorted(merged):
            raise ValueError("only byte-level vocabularies whose ids follow the merges are supported")
        shown = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
        rest = iter(range(256, 512))
        sign = {chr(b) if b in shown else chr(next(rest)): b for b in range(256)}
        entries = {i: bytes(map(sign.__getitem__, token)) for token, i in vocab.items() if set(token) <= sign.keys()}
        self.bytes = [entries.get(i, b"") for i in range(max(vocab.values()) + 1)]
        coder = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in entries.items()}, special_tokens={})
        self.encode = lambda texts: [coder.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]


class Pieces:
    """Encoding by a SentencePiece model."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        if model.encode("a") == model.encode(" a"):
            raise ValueError("only models that put a blank before the text and keep the text's own are supported")
        self.bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(BLANK, " ").encode())
        self.encode = lambda texts: model.encode(texts, num_threads=1)


class Side:
    """One tokenizer with its tables."""

    def __init__(self, coder: ByteBpe | Pieces):
        self._encode = coder.encode
        self.size = len(coder.bytes)
        self._bytes = pa.array(coder.bytes, pa.binary())
        self._length = pa.array([len(b) for b in coder.bytes], pa.int64())
        self._name = pa.array([str(i) for i in range(self.size)])

    def lists(self, texts: list[str]) -> pa.ListArray:
        found = self._encode(texts)
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate([np.asarray(f, np.int32) for f in found]) if len(found) else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self._bytes.take(ids.values)), pa.scalar(b"", pa.binary()))

    def ends(self, ids: pa.ListArray) -> tuple[pa.Array, pa.Array]:
        """Parent and end in bytes within its text, of every token."""
        parent = pc.cast(pc.list_parent_indices(ids), pa.int64())
        total = pc.cumulative_sum(self._length.take(ids.flatten()))
        starts = ids.offsets.to_numpy()[:-1]
        before = np.r_[0, total.to_numpy()][starts]
        return parent, pc.subtract(total, pa.array(before).take(parent))

    def names(self, ids: pa.Array, group_ends: np.ndarray) -> pa.Array:
        """Ids of each group, joined by commas."""
        offsets = pa.array(np.r_[0, group_ends + 1].astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self._name.take(ids)), ",")


def keyed(parent: pa.Array, end: pa.Array, span: int) -> pa.Array:
    return pc.add(pc.multiply(parent, pa.scalar(span, pa.int64())), end)


def aligned(texts: list[str | None], a: Side, b: Side) -> dict[str, pa.Array]:
    """Numbers, groups, and the distinct linked pairs (as a id * b's size + b id)
    with their number, of every text."""
    n = len(texts)
    some = [i for i, t in enumerate(texts) if t]
    given = [texts[i] for i in some]
    ids_a, ids_b = a.lists(given), b.lists(given)
    whole = pa.array([(" " + t).encode() for t in given], pa.binary())
    kept = pc.and_(pc.equal(a.joined(ids_a), whole), pc.equal(b.joined(ids_b), whole))
    at = np.asarray(some, np.int64)[kept.to_numpy(zero_copy_only=False)]
    ids_a, ids_b = ids_a.filter(kept), ids_b.filter(kept)
    (parent_a, end_a), (parent_b, end_b) = a.ends(ids_a), b.ends(ids_b)
    flat_a, flat_b = ids_a.flatten(), ids_b.flatten()
    span = max([len(w) for w in whole.to_pylist()], default=0) + 1
    left = pa.table({"key": keyed(parent_a, end_a, span), "a": pa.array(np.arange(len(flat_a)))})
    right = pa.table({"key": keyed(parent_b, end_b, span), "b": pa.array(np.arange(len(flat_b)))})
    places = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key")
    both = pc.and_(pc.is_valid(places["a"]), pc.is_valid(places["b"]))
    ends = places.filter(both)
    doc = np.asarray(pc.divide(places["key"].combine_chunks(), pa.scalar(span, pa.int64())))
    per_doc = lambda docs: np.bincount(docs, minlength=len(at)).astype(np.int64)
    last_a, last_b = ends["a"].to_numpy(), ends["b"].to_numpy()
    groups = per_doc(doc[both.to_numpy()])
    text_of = pc.binary_join_element_wise(a.names(flat_a, last_a), b.names(flat_b, last_b), "|")
    text_of = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(groups)].astype(np.int32)), text_of), ";")
    of_a = flat_a.take(pc.fill_null_backward(places["a"]).combine_chunks())
    of_b = flat_b.take(pc.fill_null_backward(places["b"]).combine_chunks())
    pair = pc.add(pc.multiply(pc.cast(of_a, pa.int64()), pa.scalar(b.size, pa.int64())), pc.cast(of_b, pa.int64()))
    times = pa.table({"doc": pa.array(doc), "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    times = times.take(pa.array(np.argsort(times["doc"].to_numpy(), kind="stable")))

    def spread(values: np.ndarray) -> pa.Array:
        out = np.zeros(n, np.int64)
        out[at] = values
        return pa.array(out)

    distinct = np.zeros(n, np.int64)
    distinct[at] = per_doc(times["doc"].to_numpy())
    offsets = pa.array(np.r_[0, np.cumsum(distinct)].astype(np.int32))
    where = np.full(n, -1, np.int64)
    where[at] = np.arange(len(at))
    texts_of = pc.fill_null(text_of.take(pa.array(where, mask=where < 0)), "")
    return {
        "n_a": spread(np.diff(ids_a.offsets.to_numpy())),
        "n_b": spread(np.diff(ids_b.offsets.to_numpy())),
        "n_groups": spread(groups),
        "n_links": spread(per_doc(doc)),
        "groups": texts_of,
        "pairs": pa.ListArray.from_arrays(offsets, times["pair"].combine_chunks()),
        "times": pa.ListArray.from_arrays(offsets, pc.cast(times["count_all"].combine_chunks(), pa.int32())),
    }


def align(docs: DataFrame, text: str = "text", model_a: str | bytes = MODEL_A, model_b: str | bytes = MODEL_B) -> DataFrame:
    """``docs`` without the text; adds n_a, n_b, n_groups, n_links, ``groups``
    (``a1,a2|b1;a3|b2,b3``), ``block``, and the distinct linked ``pairs`` with
    the ``times`` each is linked in the text (see ``counted``). The models are
    paths the session's driver can read, or their content."""
    docs = docs.drop(*[c for c in docs.columns if c != text and c.lower() in RESULTS])
    kept = [c for c in docs.columns if c != text]
    data = []
    for model in (model_a, model_b):
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        data.append(model)
    key = ("align", *(hashlib.sha256(m).hexdigest() for m in data))
    added = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>, block bigint"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = kept_for(key, lambda: (Side(ByteBpe(data[0])), Side(Pieces(data[1]))))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text):
                new = aligned(part.column(text).to_pylist(), a, b)
                new["block"] = pa.array(np.full(part.num_rows, block))
                block += 1
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + list(new.values()), kept + list(new))

    return docs.mapInArrow(run, schema)


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, pair, docs: how many texts of a block hold a pair; partial counts."""
    for batch in batches:
        pairs = batch.column("pairs")
        table = pa.table({"block": batch.column("block").take(pc.list_parent_indices(pairs)), "pair": pairs.flatten()})
        counted = table.group_by(["block", "pair"], use_threads=False).aggregate([([], "count_all")])
        yield from counted.rename_columns(["block", "pair", "docs"]).combine_chunks().to_batches()


def counted(docs: DataFrame, size_b: int) -> DataFrame:
    """``docs``, a written result of ``align`` without its ``groups``, with the
    columns ``n_best`` and ``count_sum`` for ``block, pairs, times``.

    The count of a pair is the number of texts that hold it; ``n_best`` are the
    links whose pair has the highest count of all pairs of its A id.
    ``size_b`` is the number of B's ids.
    """
    wanted = Staged(docs.select("block", "pairs").mapInArrow(asked, "block bigint, pair bigint, docs bigint")).df
    counts = Staged(
        wanted.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.floor(F.col("pair") / size_b))
    ).df
    # one row per id of A's vocabulary at most
    best = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    rated = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = wanted.select("block", "pair").join(rated, "pair")
    kept = [c for c in docs.columns if c not in ("block", "pairs", "times")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + ["n_best bigint", "count_sum bigint"])

    def close(rows: pa.Table, told: pa.Table) -> pa.Table:
        pairs, times = rows["pairs"].combine_chunks(), rows["times"].combine_chunks()
        links = pa.table({"row": pc.list_parent_indices(pairs), "pair": pairs.flatten(), "times": pc.cast(times.flatten(), pa.int64())})
        told = told.group_by("pair", use_threads=False).aggregate([("count", "max"), ("best", "max")])  # asked for by two batches
        links = links.join(told, "pair", join_type="inner", use_threads=False)
        sums = pa.table({
            "row": links["row"],
            "n_best": pc.multiply(links["times"], pc.cast(links["best_max"], pa.int64())),
            "count_sum": pc.multiply(links["times"], links["count_max"]),
        }).group_by("row", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
        out = {c: rows[c] for c in kept}
        for name in ("n_best", "count_sum"):
            values = np.zeros(rows.num_rows, np.int64)
            values[sums["row"].to_numpy()] = sums[f"{name}_sum"].to_numpy()
            out[name] = pa.array(values)
        return pa.table(out)

    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(close, schema)

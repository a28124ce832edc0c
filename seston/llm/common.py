"""Helpers the text operators share: folds, labelled samples, passes over
whole texts in tasks, logistic calibration and connected components."""

from __future__ import annotations

import ctypes
import gc
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seston.durable import Staged

SLICE_BYTES = 4_000_000
#: bits in a row of a sieve (a bitmap of Spark holds as many) and the most rows of one, 8 MB in all
SIEVE_BITS, SIEVE_ROWS = 32_768, 2_048


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about ``SLICE_BYTES`` of text, whole rows."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def over_texts(
    df: DataFrame, text: str, make: Callable[[], Callable[[list], dict[str, pa.Array]]], added: str,
    keep_text: bool = False,
) -> DataFrame:
    """``df`` with the columns ``added`` (a DDL list), and without ``text``
    unless it is kept. A column of ``df`` named like an added one, in whatever
    case, is replaced by it.

    ``make`` runs once per task and returns a function from texts (None for
    NULL) to the added columns. Texts are handed over whole, a slice at a time.
    """
    new_names = {f.name.lower() for f in StructType.fromDDL(added)}
    df = df.drop(*[c for c in df.columns if c != text and c.lower() in new_names])
    kept = [c for c in df.columns if (keep_text or c != text) and c.lower() not in new_names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                new = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + list(new.values()), kept + list(new)
                )

    return df.mapInArrow(run, schema)


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def unused_prefix(names: Iterable[str], df: DataFrame) -> str:
    """A prefix that makes of ``names`` columns that ``df`` does not have."""
    have, prefix = {c.lower() for c in df.columns}, "_"
    while any((prefix + n).lower() in have for n in names):
        prefix += "_"
    return prefix


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int,
    doc_id: str = "doc_id", text: str = "text",
) -> list[tuple[str, int]]:
    """At most ``per_class`` whole texts for each value 0 and 1 of ``label``.

    Rows are taken in the order of a hash of their id, so reruns agree and the
    choice does not depend on the order of the tables. The bound is the only
    thing that keeps the sample small: it is the one part of a model that
    passes the driver. Ids that are labelled twice count with the smaller label,
    ids of several texts with the last of them in code-point order.
    """
    known = (
        labels.where(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(doc_id)
        .agg(F.min(label).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64(doc_id))
    )
    present = docs.where(F.col(text).isNotNull()).select(doc_id)
    known = known.join(present, doc_id, "left_semi")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy("_order", doc_id).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)
    rows = rows.groupBy("_order", doc_id, "_label").agg(F.max(text)).collect()
    return [(t, label) for _, _, label, t in sorted(rows, key=lambda r: (r[0], r[1]))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and slopes by Newton steps with a small ridge on the slopes."""
    x = np.asarray(x, float)
    x = x.reshape(len(y), -1) if x.size else x.reshape(len(y), x.shape[-1] if x.ndim > 1 else 1)
    y = np.asarray(y, float)
    a = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(a.shape[1])
    if not len(y) or y.min() == y.max():
        # one class only: the smoothed share of ones, whatever the features
        w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return w
    penalty = np.full(a.shape[1], ridge * len(y))
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).reshape(len(x), -1)
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -35, 35)))


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable from every id of an edge.

    ``edges`` has long columns ``a`` and ``b``. Every round links each id to the
    smallest id among itself and its neighbours and then replaces both ends of
    an edge by these smallest ids, so a chain shrinks geometrically. Each
    round is written to the shared folder; nothing is collected. The joins are
    plain equi-joins on an id, which adaptive execution may split, and the
    minimum is taken by an aggregation that combines before it shuffles.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current = Staged(both)
    names: Staged | None = None
    while True:
        live = current.df
        if live.isEmpty():
            current.drop()
            break
        ends = live.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
            live.select(F.col("b").alias("id"), F.col("a").alias("other"))
        )
        least = ends.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("to"))
        step = Staged(least)
        to = step.df
        # parents of parents: one jump along the chain in the same round
        jump = to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.id"), "left").select(
            F.col("x.id").alias("id"), F.coalesce("y.to", "x.to").alias("to")
        )
        jumped = Staged(jump)
        to = jumped.df
        step.drop()
        if names is None:
            renamed = to
        else:
            renamed = (
                names.df.join(to.withColumnRenamed("id", "mid").withColumnRenamed("to", "new"), F.col("to") == F.col("mid"), "left")
                .select("id", F.coalesce("new", "to").alias("to"))
            )
        fresh = Staged(renamed)
        left = to.select(F.col("id").alias("a"), F.col("to").alias("na"))
        right = to.select(F.col("id").alias("b"), F.col("to").alias("nb"))
        shrunk = (
            live.join(left, "a").join(right, "b")
            .where("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .distinct()
        )
        after = Staged(shrunk)
        for old in (current, jumped, names):
            if old is not None:
                old.drop()
        current, names = after, fresh
    if names is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).where("false")
    return names.df.select("id", F.col("to").alias("component"))


class Sieve:
    """The hashes ``h`` of a written table as bits, to tell most rows that are
    none of them before a join moves them. It has 16 bits a hash, up to
    ``SIEVE_ROWS`` rows, and is sent to every task. Of very many hashes it holds
    back fewer rows; it never misses one of them."""

    def __init__(self, hashes: DataFrame):
        self._rows = min(SIEVE_ROWS, max(1, math.ceil(16 * hashes.count() / SIEVE_BITS)))
        row, bit = self._spot(F.col("h"))
        self._bits = Staged(hashes.select(row.alias("row"), bit.alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")))

    def _spot(self, hashed: Column) -> tuple[Column, Column]:
        spot = F.pmod(hashed, F.lit(self._rows * SIEVE_BITS))
        return F.shiftright(spot, 15), spot.bitwiseAND(F.lit(SIEVE_BITS - 1))

    def parted(self, df: DataFrame, hashed: Column) -> tuple[DataFrame, DataFrame]:
        """The rows of ``df`` whose hash may be one of the sieve, and those whose
        hash is none. A NULL hash is none."""
        mark = unused("_sieve", df)
        row, bit = self._spot(hashed)
        bits = F.broadcast(self._bits.df.select(F.struct("row", "bits").alias(mark)))
        byte = F.substring(F.col(mark)["bits"], (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        there = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
        both, own = df.join(bits, row == F.col(mark)["row"], "left"), [F.col(f"`{c}`") for c in df.columns]
        there = F.coalesce(there, F.lit(False))
        return both.where(there).select(*own), both.where(~there).select(*own)

    def drop(self) -> None:
        self._bits.drop()


#: ASCII bytes that are not letters become blanks; bytes of longer characters stay.
_LETTERS_ONLY = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: blocks of punctuation and symbols beyond ASCII
_MARKS = re.compile("[\u0080-©«-´¶-¹»-¿×÷ -⯿　-〿＀-＠￰-￿\U0001f000-\U0001faff]+")


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters as UTF-8, over the whole text.

    Everything in ASCII that is not a letter separates words, and so do the
    blocks of punctuation and symbols beyond it.
    """
    if not text:
        return []
    low = text.lower()
    data = low.encode("utf-8", "surrogatepass")
    if len(data) != len(low) and _MARKS.search(low):
        data = _MARKS.sub(" ", low).encode("utf-8", "surrogatepass")
    return data.translate(_LETTERS_ONLY).split()


_KEPT: dict = {}


def kept_for(key: tuple, build: Callable):
    """What ``build`` returns, kept for later tasks of the same worker; only the
    last thing built is kept."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = build()
    return _KEPT[key]


def let_go() -> None:
    """Give back the memory of work before in the same worker: what it kept, and
    what Arrow and the C library hold for later use. A worker lives on through
    all stages of a pipeline, beside the JVM of its executor."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)

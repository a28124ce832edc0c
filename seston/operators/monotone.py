"""Monotone regression of ordination distances on dissimilarities, on single pairs.

The fitted curve is the least-squares non-decreasing one through all pairs in
the order of their dissimilarity; pairs of equal dissimilarity are put in the
order of their distance, so they may be fitted differently (weak ties). It is
the slope of the greatest convex minorant of the running sum, and that can be
found in parts:

1. pairs lie in chunks of neighbouring dissimilarity, written once; each task
   pools the violators of its chunk;
2. a pool whose mean is above every mean of the chunks before it and below every
   mean of those after it is final, since pooling only averages; of every chunk
   only the lowest and the highest mean leave the task to find this out;
3. the few pools left are pooled across the chunks, one task per start, and
   their values go back to the chunks they came from.

The order in which neighbouring violators are pooled does not matter, so this is
the exact curve however many chunks there are. All starts go through together.

A configuration is ``n x k`` numbers a start, for a table of ``n (n - 1) / 2``
pairs; it is what every task needs and is sent to all, as many starts at a time
as fit ``SENT_BYTES``. Pairs of one dissimilarity share a chunk, so a value that
ties very many pairs makes one long task (24 bytes a pair and start).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.durable import Staged
from seston.operators.ranks import cuts_below

SENT_BYTES = 200_000_000
CHUNK_PAIRS = 250_000


def pooled(sums: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pools of a sequence (sums, weights) whose means increase, and the place
    in the sequence at which each begins."""
    first = np.arange(len(sums))
    for _ in range(30):  # whole runs of violators at a time, which ends early as a rule
        means = sums / weights
        rising = np.r_[True, means[:-1] < means[1:]][: len(sums)]
        if rising.all():
            return sums, weights, first
        begin = np.flatnonzero(rising)
        sums, weights, first = np.add.reduceat(sums, begin), np.add.reduceat(weights, begin), first[begin]
    out: list[list[float]] = []
    for s, w, f in zip(sums.tolist(), weights.tolist(), first.tolist(), strict=True):
        out.append([s, w, f])
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            s, w, _ = out.pop()
            out[-1][0] += s
            out[-1][1] += w
    table = np.array(out)
    return table[:, 0], table[:, 1], table[:, 2].astype(np.int64)


def fitted(pairs: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one chunk (i, j, d, in the order of d) and one configuration: gaps and
    distances in the order of the fit, that order, and the pools."""
    i, j, d = pairs
    gap = at[i] - at[j]
    apart = np.sqrt((gap * gap).sum(1))
    new = d[1:] != d[:-1]
    order = np.arange(len(d)) if new.all() else np.lexsort((apart, np.r_[0, np.cumsum(new)]))
    gap, apart = gap[order], apart[order]
    return gap, apart, order, *pooled(apart, np.ones(len(apart)))


class Ranked:
    """All pairs of ``n`` samples, numbered, in chunks of neighbouring rank."""

    def __init__(self, pairs: DataFrame, chunk_pairs: int | None = None):
        spark = pairs.sparkSession
        kept = Staged(pairs.select("sample_1", "sample_2", "distance"))
        counted = kept.df.agg(
            F.count(F.lit(1)), F.count_if(F.col("distance").isNull() | F.isnan(F.col("distance").cast("double")))
        ).first()
        names = kept.df.select(F.col("sample_1").alias("sample")).union(kept.df.select("sample_2")).distinct()
        # as many names as there are rows of a configuration
        self.names = sorted(r[0] for r in names.collect())
        self.n, self.pairs = len(self.names), counted[0]
        if counted[1] or 2 * self.pairs != self.n * (self.n - 1):
            raise ValueError(f"{self.pairs} pairs, {counted[1]} without a distance, of {self.n} samples: every pair is needed")
        numbered = pa.table({"sample": pa.array(self.names), "at": pa.array(range(self.n), pa.int32())})
        self.samples = spark.createDataFrame(numbered)
        one = self.samples.select(F.col("sample").alias("sample_1"), F.col("at").alias("i"))
        two = self.samples.select(F.col("sample").alias("sample_2"), F.col("at").alias("j"))
        size = chunk_pairs or max(CHUNK_PAIRS, 50 * self.n)
        parts = max(-(-self.pairs // size), 1 if chunk_pairs else min(spark.sparkContext.defaultParallelism, 1 + self.pairs // 20_000))
        value = F.col("distance").cast("double")
        shares = [p / parts for p in range(1, parts)]
        cuts = sorted(set(kept.df.agg(F.percentile_approx(value, shares, 20 * parts)).first()[0] or [])) if shares else []
        levels = max(len(cuts), 1).bit_length()
        place = cuts_below(value, F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), levels)
        rows = kept.df.join(one, "sample_1").join(two, "sample_2").select(place.alias("chunk"), "i", "j", value.alias("d"))

        def pack(table: pa.Table) -> pa.Table:
            i, j, d = (table[c].to_numpy() for c in ("i", "j", "d"))
            order = np.lexsort((j, i, d))
            return pa.table({"chunk": table["chunk"][:1], **{c: [x[order]] for c, x in (("i", i), ("j", j), ("d", d))}})

        packed = rows.groupBy("chunk").applyInArrow(pack, "chunk int, i array<int>, j array<int>, d array<double>")
        self._chunks = Staged(packed.repartition(parts, "chunk"))
        kept.drop()

    def drop(self) -> None:
        self._chunks.drop()

    def _over(self, table: DataFrame, work: Callable, at: np.ndarray, schema: str) -> DataFrame:
        """``work(chunk, pairs, configurations, told)`` for every chunk, which
        yields dictionaries of columns."""
        sent = table.sparkSession.sparkContext.broadcast(at)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    pairs = tuple(batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("i", "j", "d"))
                    told = batch.column("told")[row].as_py() if "told" in batch.schema.names else None
                    for out in work(batch.column("chunk")[row].as_py(), pairs, sent.value, told):
                        yield pa.RecordBatch.from_pydict(out)

        return table.mapInArrow(run, schema)

    def fit(self, at: np.ndarray) -> DataFrame:
        """start, chunk, stress, and the values of pools that are pooled across
        chunks: pool numbers ``which`` and ``value``. ``at`` has the shape
        (starts, n, k)."""
        if at[0].nbytes > SENT_BYTES:
            raise ValueError("a configuration is too large to send to every task")

        def ends(chunk: int, pairs: tuple, at: np.ndarray, _) -> Iterator[dict]:
            found = [fitted(pairs, x) for x in at]
            yield {
                "start": np.arange(len(at), dtype=np.int32), "chunk": np.full(len(at), chunk, np.int32),
                "low": [f[3][0] / f[4][0] for f in found], "high": [f[3][-1] / f[4][-1] for f in found],
            }

        limits = self._over(self._chunks.df, ends, at, "start int, chunk int, low double, high double").toArrow()
        chunks = np.unique(limits["chunk"].to_numpy())
        place = np.searchsorted(chunks, limits["chunk"].to_numpy())
        low, high = np.zeros((2, len(at), len(chunks)))
        low[limits["start"].to_numpy(), place] = limits["low"].to_numpy()
        high[limits["start"].to_numpy(), place] = limits["high"].to_numpy()
        edge = np.full((len(at), 1), np.inf)
        before = np.c_[-edge, np.maximum.accumulate(high, 1)[:, :-1]]
        after = np.c_[np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1][:, 1:], edge]

        def live(chunk: int, pairs: tuple, at: np.ndarray, _) -> Iterator[dict]:
            c = int(np.searchsorted(chunks, chunk))
            for start, x in enumerate(at):
                _, apart, _, sums, weights, _ = fitted(pairs, x)
                means = sums / weights
                open_ = (means <= before[start, c]) | (means >= after[start, c])
                done = ~open_
                yield {
                    "start": np.array([start], np.int32), "chunk": np.array([chunk], np.int32),
                    "which": [np.flatnonzero(open_).astype(np.int32)], "sums": [sums[open_]], "weights": [weights[open_]],
                    "squares": [(apart * apart).sum()], "explained": [(sums[done] ** 2 / weights[done]).sum()],
                }

        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by("chunk")
            flat = lambda c: table[c].combine_chunks().flatten().to_numpy()
            sums, weights, first = pooled(flat("sums"), flat("weights"))
            counts = np.diff(np.r_[first, len(table["sums"].combine_chunks().flatten())]) if len(first) else first
            values = np.repeat(sums / weights, counts)
            squares = table["squares"].to_numpy().sum()
            loss = squares - table["explained"].to_numpy().sum() - (sums * sums / weights).sum()
            offsets = table["which"].combine_chunks().offsets
            values = pa.ListArray.from_arrays(pc_shift(offsets), pa.array(values, pa.float64()))
            stress = np.sqrt(max(loss, 0.0) / squares) if squares > 0 else 0.0
            return pa.table({
                "start": table["start"], "chunk": table["chunk"], "which": table["which"], "value": values,
                "stress": pa.array(np.full(table.num_rows, stress)),
            })

        pools = self._over(
            self._chunks.df, live, at,
            "start int, chunk int, which array<int>, sums array<double>, weights array<double>, squares double, explained double",
        )
        return pools.groupBy("start").applyInArrow(merge, "start int, chunk int, which array<int>, value array<double>, stress double")

    def with_values(self, at: np.ndarray, work: Callable, schema: str) -> DataFrame:
        """``work(chunk, pairs, configuration, gap, apart, order, fit, start, stress)``
        for every chunk and start; the last arrays are in the order of the fit."""

        def run(chunk: int, pairs: tuple, at: np.ndarray, told: list) -> Iterator[dict]:
            for start, which, value, stress in ((t["start"], t["which"], t["value"], t["stress"]) for t in told):
                gap, apart, order, sums, weights, first = fitted(pairs, at[start])
                means = sums / weights
                means[np.asarray(which, np.int64)] = value
                fit = np.repeat(means, np.diff(np.r_[first, len(apart)]))
                yield work(chunk, pairs, gap, apart, order, fit, start, stress)

        told = self.fit(at).groupBy("chunk").agg(F.collect_list(F.struct("start", "which", "value", "stress")).alias("told"))
        return self._over(self._chunks.df.join(told, "chunk"), run, at, schema)


def pc_shift(offsets: pa.Array) -> pa.Array:
    """Offsets that begin at 0."""
    values = offsets.to_numpy()
    return pa.array(values - values[0])

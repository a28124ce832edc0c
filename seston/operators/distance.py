"""Distances between samples, standardisation, and weighted taxon scores.

A community is a long table (sample, taxon, value) without zeros. Samples are
put into blocks by a hash, and each pair of blocks is one unit of work: a task
holds the cells of two blocks and one number per pair of their samples, and its
work follows the cells that are not zero. A taxon found in every sample needs no
special care because taxa are never a shuffle key. Cells are sent once per
block, so the shuffle grows with cells x blocks; the number of pairs is in the
nature of a distance table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seston.durable import stage
from seston.operators.joins import natural_join

BLOCK = 512
# Share of two squared lengths below which their difference is not trusted.
CANCELLED = 1e-6


def block_count(samples: int, slots: int, size: int = BLOCK) -> int:
    """Blocks of about ``size`` samples (a hash deals them) whose pairs give
    every task slot work, but a block is not too small to be worth a task."""
    for_work = min(math.ceil(math.sqrt(2 * slots)), math.ceil(samples / 32))
    return max(1, math.ceil(samples / size), for_work)


def gather_block_pairs(df: DataFrame, blocks: int) -> DataFrame:
    """Rows of a pair of blocks into one task, about one pair per task. Work
    per row is high, so the count is fixed and not merged by row bytes."""
    pairs = blocks * (blocks + 1) // 2
    return df.repartition(pairs, "low_block", "high_block")


def block_of(sample: Column | str, blocks: int) -> Column:
    c = F.col(sample) if isinstance(sample, str) else sample
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def to_block_pairs(df: DataFrame, blocks: int) -> DataFrame:
    """Send each row (with its ``block``) to every pair of blocks it is part of."""
    other = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return other.select(
        F.least("block", "__other").alias("low_block"),
        F.greatest("block", "__other").alias("high_block"),
        *df.columns,
    )


def community(df: DataFrame, sample: str, taxon: str, value: str) -> DataFrame:
    """One row per sample and taxon with the summed value; rows lacking a part
    are left out."""
    return df.na.drop(subset=[sample, taxon, value]).groupBy(sample, taxon).agg(
        F.sum(F.col(value).cast("double")).alias(value)
    )


def _rows(cells: pd.DataFrame) -> tuple[np.ndarray, dict]:
    """Samples of a block, and per taxon the rows it occurs in and its values
    there: as many numbers as there are cells."""
    row, ids = pd.factorize(cells["sample"], sort=True)
    values = cells["value"].to_numpy()
    by_taxon = {
        t: (row[at], values[at]) for t, at in cells.groupby("taxon", sort=False).indices.items()
    }
    return np.asarray(ids), by_taxon


def _totals(by_taxon: dict, n: int, power: int) -> np.ndarray:
    total = np.zeros(n)
    for rows, values in by_taxon.values():
        total[rows] += values**power
    return total


def _bray_curtis(a: dict, b: dict, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    shared = np.zeros((na, nb))
    for t in a.keys() & b.keys():
        (i, v), (j, w) = a[t], b[t]
        shared[np.ix_(i, j)] += np.minimum.outer(v, w)
    mass = _totals(a, na, 1)[:, None] + _totals(b, nb, 1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - 2.0 * shared / mass, shared > 0


def _euclidean(a: dict, b: dict, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    product = np.zeros((na, nb))
    for t in a.keys() & b.keys():
        (i, v), (j, w) = a[t], b[t]
        product[np.ix_(i, j)] += np.multiply.outer(v, w)
    size = _totals(a, na, 2)[:, None] + _totals(b, nb, 2)[None, :]
    square = size - 2.0 * product
    # where nearly all cancels, the digits left are noise: add up the differences
    close = np.argwhere(square <= CANCELLED * size)
    if len(close):
        left, right = _by_sample(a), _by_sample(b)
        for i, j in close:
            x, y = left.get(i, {}), right.get(j, {})
            square[i, j] = sum((x.get(t, 0.0) - y.get(t, 0.0)) ** 2 for t in x.keys() | y.keys())
    return np.sqrt(square), np.ones((na, nb), dtype=bool)


def _by_sample(by_taxon: dict) -> dict:
    out: dict = {}
    for t, (rows, values) in by_taxon.items():
        for i, v in zip(rows.tolist(), values.tolist(), strict=True):
            out.setdefault(i, {})[t] = v
    return out


#: what a task can compute of two blocks
MEASURES = {"bray_curtis": _bray_curtis, "euclidean": _euclidean}


def of_blocks(cells: pd.DataFrame, low: int, high: int, measure: Callable) -> tuple[np.ndarray, ...]:
    """Samples of two blocks, their distances, and which of them share a taxon."""
    ids_a, a = _rows(cells[cells["block"] == low].reset_index(drop=True))
    ids_b, b = (ids_a, a) if low == high else _rows(cells[cells["block"] == high].reset_index(drop=True))
    return ids_a, ids_b, *measure(a, b, len(ids_a), len(ids_b))


def _pair_table(
    df: DataFrame,
    sample: str,
    taxon: str,
    value: str,
    measure: Callable,
    only_sharing: bool,
    block: int,
) -> DataFrame:
    cells = stage(
        community(df, sample, taxon, value).select(
            F.col(sample).alias("sample"), F.col(taxon).alias("taxon"), F.col(value).alias("value")
        )
    )
    slots = df.sparkSession.sparkContext.defaultParallelism
    blocks = block_count(cells.select("sample").distinct().count(), slots, block)
    placed = to_block_pairs(cells.withColumn("block", block_of("sample", blocks)), blocks)

    def measured(cells: pd.DataFrame) -> pd.DataFrame:
        low, high = cells["low_block"].iat[0], cells["high_block"].iat[0]
        ids_a, ids_b, d, sharing = of_blocks(cells, low, high, measure)
        keep = sharing if only_sharing else np.ones(d.shape, dtype=bool)
        if low == high:
            keep = np.triu(keep, 1)
        i, j = np.nonzero(keep)
        first, second = ids_a[i], ids_b[j]
        swap = first > second
        return pd.DataFrame(
            {
                "sample_1": np.where(swap, second, first),
                "sample_2": np.where(swap, first, second),
                "distance": d[i, j],
            }
        )

    kind = cells.schema["sample"].dataType.simpleString()
    return gather_block_pairs(placed, blocks).groupBy("low_block", "high_block").applyInPandas(
        measured, f"sample_1 {kind}, sample_2 {kind}, distance double"
    )


def bray_curtis(
    df: DataFrame,
    sample: str,
    taxon: str,
    value: str,
    only_sharing: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Bray-Curtis dissimilarity of every pair of samples, sample_1 < sample_2.

    Two samples without a taxon in common are exactly 1 apart; ``only_sharing``
    leaves those out. Two empty samples give NULL. The summed community is
    written to the shared folder when this is called.
    """
    return _pair_table(df, sample, taxon, value, _bray_curtis, only_sharing, block)


def euclidean(
    df: DataFrame, sample: str, taxon: str, value: str, block: int = BLOCK
) -> DataFrame:
    """Euclidean distance of every pair of samples, sample_1 < sample_2."""
    return _pair_table(df, sample, taxon, value, _euclidean, False, block)


def sqrt_transform(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.sqrt(F.col(value).cast("double")))


def wisconsin(df: DataFrame, sample: str, taxon: str, value: str) -> DataFrame:
    """Divide by the largest value of the taxon, then by the sample total."""
    cells = community(df, sample, taxon, value)
    top = cells.groupBy(taxon).agg(F.max(value).alias("__top"))
    scaled = natural_join(cells, top, "left", [taxon]).select(
        sample, taxon, (F.col(value) / F.when(F.col("__top") != 0, F.col("__top"))).alias(value)
    )
    # a sample has at most one row per taxon here
    mass = F.sum(value).over(W.partitionBy(sample))
    return scaled.withColumn("__mass", mass).select(
        sample, taxon, (F.col(value) / F.when(F.col("__mass") != 0, F.col("__mass"))).alias(value)
    )


def ordination_input(df: DataFrame, sample: str, taxon: str, value: str) -> DataFrame:
    """The usual preparation before ordination: square root if the largest
    value is above 50, double standardisation if it is above 9."""
    cells = community(df, sample, taxon, value)
    largest = cells.agg(F.max(value)).first()[0] or 0
    if largest > 50:
        cells = sqrt_transform(cells, value)
    return wisconsin(cells, sample, taxon, value) if largest > 9 else cells


def species_scores(
    scores: DataFrame, df: DataFrame, sample: str, taxon: str, value: str, axes: Sequence[str]
) -> DataFrame:
    """Position of each taxon: mean of the positions of its samples, weighted
    by its value in them."""
    placed = natural_join(community(df, sample, taxon, value), scores.select(sample, *axes), "inner", [sample])
    weight = F.when(F.sum(value) != 0, F.sum(value))
    return placed.groupBy(taxon).agg(
        *[(F.sum(F.col(value) * F.col(a)) / weight).alias(a) for a in axes]
    )

"""Grouped sums, counts, ranges, audits and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.functions.numbers import power_of_ten_steps, ratio
from seston.operators.joins import natural_join


def _keep_keys(df: DataFrame, keys: Sequence[str], drop_null_keys: bool) -> DataFrame:
    return df.na.drop(subset=list(keys)) if drop_null_keys and keys else df


def _check_na(na: str) -> None:
    if na not in ("skip", "propagate"):
        raise ValueError(f"na must be 'skip' or 'propagate', not {na!r}")


def total(c: str | Column, na: str = "skip") -> Column:
    """Sum: "skip" ignores NULL and gives 0 for no values, "propagate" gives
    NULL if any value is missing."""
    _check_na(na)
    c = F.col(c) if isinstance(c, str) else c
    if na == "skip":
        return F.coalesce(F.sum(c), F.lit(0))
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def average(c: str | Column, na: str = "skip") -> Column:
    """Mean: "skip" ignores NULL, "propagate" gives NULL if any is missing."""
    _check_na(na)
    c = F.col(c) if isinstance(c, str) else c
    if na == "skip":
        return F.avg(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key; a missing key is a group of its own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sum_by(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    na: str = "skip",
    drop_null_keys: bool = False,
    decimals: int | None = None,
    wide: bool = False,
) -> DataFrame:
    """Sums per key. Whole numbers and decimals keep their kind and every digit;
    a sum beyond it raises an error, unless ``wide`` is set: then sums of whole
    numbers are decimals of 38 digits, which hold any that can occur. Other
    columns are added as doubles, whose last digits depend on the order of the
    rows, unless ``decimals`` is given: then each value is rounded to so many
    decimals and added as a whole number, exactly and in any order.
    """
    sums = [_summed(df, c, na, decimals, wide).alias(c) for c in cols]
    return _keep_keys(df, keys, drop_null_keys).groupBy(*keys).agg(*sums)


def _summed(df: DataFrame, c: str, na: str, decimals: int | None, wide: bool) -> Column:
    kind = df.schema[c].dataType if c in df.columns else None
    if isinstance(kind, T.DecimalType):
        return total(F.col(c), na)
    if isinstance(kind, T.IntegralType):
        # a sum has ten digits more than its values
        return total(F.col(c).cast("decimal(28,0)" if wide else "bigint"), na)
    x = F.col(c).cast("double")
    if decimals is None:
        return total(x, na).cast("double")
    whole = F.round(x * F.lit(10.0**decimals)).cast("decimal(38,0)")
    return total(whole, na).cast("double") / F.lit(10.0**decimals)


def mean_by(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    na: str = "skip",
    drop_null_keys: bool = False,
) -> DataFrame:
    return _keep_keys(df, keys, drop_null_keys).groupBy(*keys).agg(
        *[average(F.col(c), na).alias(c) for c in cols]
    )


def replicate_mean(
    df: DataFrame,
    keys: Sequence[str],
    taxon: str,
    replicate: str,
    cols: Sequence[str],
    absent: str = "skip",
) -> DataFrame:
    """Mean of replicate samples per ``keys`` and taxon.

    "skip" averages the replicates in which the taxon was found. "zero" divides
    by all replicates taken for ``keys``: a taxon absent from one counts as 0.
    """
    if absent not in ("skip", "zero"):
        raise ValueError(f"absent must be 'skip' or 'zero', not {absent!r}")
    group = [*keys, taxon]
    per_rep = sum_by(df, [*group, replicate], cols)
    if absent == "skip":
        return mean_by(per_rep, group, cols)
    sums = sum_by(per_rep, group, cols)
    taken = per_rep.select(*keys, replicate).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n")
    )
    joined = natural_join(sums, taken, "left", list(keys))
    return joined.select(*group, *[(F.col(c) / F.col("__n")).alias(c) for c in cols])


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: n, mean and sample standard deviation."""
    parts = [
        F.struct(
            F.lit(c).alias("variable"),
            F.count(c).alias("n"),
            F.avg(c).cast("double").alias("mean"),
            F.stddev_samp(c).alias("sd"),
        )
        for c in cols
    ]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def col_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: smallest and largest value as numbers."""
    parts = [
        F.struct(
            F.lit(c).alias("variable"),
            F.min(F.col(c)).cast("double").alias("low"),
            F.max(F.col(c)).cast("double").alias("high"),
        )
        for c in cols
    ]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: how many rows miss it."""
    parts = [
        F.struct(
            F.lit(c).alias("variable"),
            (F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias("missing"),
        )
        for c in cols or df.columns
    ]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """One row per column: number of different values, missing ones aside.
    ``approx`` uses a sketch: one pass without a shuffle of the values."""
    if approx:
        parts = [
            F.struct(F.lit(c).alias("variable"), F.approx_count_distinct(c).alias("n"))
            for c in cols
        ]
        return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))
    parts = [F.struct(F.lit(c).alias("variable"), F.count_distinct(F.col(f"`{c}`")).alias("n")) for c in cols]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def crosstab_long(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Combinations that occur, with their frequency."""
    return count_by(df.na.drop(subset=list(cols)), cols, name)


def fd_violations(df: DataFrame, key: str | Sequence[str], dependent: str) -> DataFrame:
    """Keys with more than one dependent value, and how many they have."""
    keys = [key] if isinstance(key, str) else list(key)
    pairs = df.select(*keys, dependent).distinct()
    counted = pairs.groupBy(*keys).agg(
        F.count(dependent).alias("n_values"),
        F.min(dependent).alias("first_value"),
        F.max(dependent).alias("last_value"),
    )
    return counted.filter(F.col("n_values") > 1)


def fd_violation_pairs(df: DataFrame, key: str | Sequence[str], dependent: str) -> DataFrame:
    """Every (key, value) combination of the violating keys with its rows."""
    keys = [key] if isinstance(key, str) else list(key)
    bad = fd_violations(df, keys, dependent).select(*keys)
    return natural_join(count_by(df, [*keys, dependent]), bad, "semi", keys)


def children_per(df: DataFrame, parent: str, child: str, name: str = "n") -> DataFrame:
    """Number of different children of each parent (species in a genus)."""
    return count_by(df.select(parent, child).distinct(), [parent], name)


def mismatch_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where two columns that should agree do not."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def mismatch_total(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many rows differ and by how much in all."""
    return df.agg(
        F.coalesce(F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")), F.lit(0)).alias("rows"),
        F.coalesce(F.sum((F.col(a) - F.col(b)).cast("double")), F.lit(0.0)).alias("difference"),
    )


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _cells(df: DataFrame, samples: Sequence[str], taxon: str, value: str | None) -> DataFrame:
    """Sample x taxon combinations, ``present`` if any value is not zero. The
    summaries below all start from this one aggregation of the rows."""
    here = F.lit(True) if value is None else F.coalesce(F.col(value) != 0, F.lit(False))
    return df.groupBy(*samples, taxon).agg(F.max(here).alias("present"))


def present_cells(
    df: DataFrame, sample: str | Sequence[str], taxon: str, value: str | None = None
) -> DataFrame:
    """Distinct sample x taxon combinations, leaving out zero values."""
    samples = _names(sample)
    return _cells(df, samples, taxon, value).filter("present").select(*samples, taxon)


def occupancy(
    df: DataFrame,
    sample: str | Sequence[str],
    taxon: str,
    value: str | None = None,
    digits: int | None = 3,
) -> DataFrame:
    """Samples in which each taxon occurs, and their share of all samples."""
    samples = _names(sample)
    cells = _cells(df, samples, taxon, value)
    # counting "present" keeps this shuffle the same as that of the cells
    each = cells.groupBy(*samples).agg(F.max("present").alias("present"))
    n_all = each.agg(F.count("present").alias("n")).scalar()
    out = count_by(cells.filter("present"), [taxon], "n_samples")
    share = F.col("n_samples") / n_all
    return out.withColumn("share", share if digits is None else F.round(share, digits))


def richness(
    df: DataFrame,
    sample: str | Sequence[str],
    taxon: str,
    value: str | None = None,
    name: str = "richness",
) -> DataFrame:
    """Number of taxa in each sample; 0 for one whose values are all zero."""
    samples = _names(sample)
    found = F.when(F.col("present"), F.col(taxon))
    return _cells(df, samples, taxon, value).groupBy(*samples).agg(F.count(found).alias(name))


def matrix_fill(
    df: DataFrame, sample: str | Sequence[str], taxon: str, value: str | None = None
) -> DataFrame:
    """Size of the sample x taxon matrix and the share of cells not zero."""
    samples = _names(sample)
    key = F.struct(*[F.col(s) for s in samples])
    sizes = _cells(df, samples, taxon, value).agg(
        F.count_distinct(key).alias("samples"),
        F.count_distinct(F.struct(taxon)).alias("taxa"),
        F.count_if("present").alias("filled"),
    )
    return sizes.withColumn("fill", ratio("filled", F.col("samples") * F.col("taxa")))


def histogram_edges(df: DataFrame, col: str, breaks: int | None = None) -> list[float]:
    """Round-numbered edges for a histogram. Runs one small aggregation. With
    no ``breaks`` their number is log2(n) + 1, rounded up."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n:
        return []
    cells = breaks or math.ceil(math.log2(n) + 1)
    return power_of_ten_steps(float(low), float(high), cells)


def histogram(df: DataFrame, col: str, breaks: int | Sequence[float] | None = None) -> DataFrame:
    """Counts in cells open on the left and closed on the right; the first cell
    also holds its left edge. Cells without values are listed with 0. A value
    that no cell holds is an error; missing values are not counted."""
    edges = breaks if isinstance(breaks, Sequence) else histogram_edges(df, col, breaks)
    edges = [float(e) for e in edges]
    if len(edges) < 2:
        return df.select(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n")).limit(0)
    last = len(edges) - 1
    slack = 1e-7 * sorted(b - a for a, b in zip(edges, edges[1:]))[(last - 1) // 2]
    x = F.col(col).cast("double")
    covered = x.between(edges[0] - slack, edges[-1] + slack)
    message = F.concat(F.lit(f"no cell of the histogram holds this value of {col}: "), x.cast("string"))
    bounds = F.array(*[F.lit(e + slack) for e in edges[1:-1]])
    cell = F.when(covered, F.size(F.filter(bounds, lambda b: b < x))).otherwise(F.raise_error(message).cast("int"))
    counted = df.filter(x.isNotNull()).groupBy(cell.alias("__i")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.posexplode(
        F.arrays_zip(
            F.array(*[F.lit(e) for e in edges[:-1]]).alias("low"),
            F.array(*[F.lit(e) for e in edges[1:]]).alias("high"),
        )
    )
    frame = df.sparkSession.range(1).select(rows.alias("__i", "e")).select("__i", "e.*")
    joined = frame.join(counted, "__i", "left")
    return joined.select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in cols]))

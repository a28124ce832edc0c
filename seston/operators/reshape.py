"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.operators.joins import natural_join


def spread(
    df: DataFrame,
    keys: Sequence[str],
    names: str,
    values: str,
    columns: Sequence[str] | None = None,
    on_dup: str = "error",
) -> DataFrame:
    """One row per key, one column per value of ``names``.

    Give ``columns`` to fix the columns and save the pass that finds them. Two
    values for one cell fail at run time, or are added up with "sum".
    """
    if on_dup not in ("error", "sum"):
        raise ValueError(f"on_dup must be 'error' or 'sum', not {on_dup!r}")
    cell = df.groupBy(*keys, names)
    if on_dup == "sum":
        one = cell.agg(F.sum(values).alias("__v"))
    else:
        only = F.when(F.count(F.lit(1)) == 1, F.first(values)).otherwise(
            F.raise_error(F.lit(f"more than one value for a cell of {list(keys)} x {names}"))
        )
        one = cell.agg(only.alias("__v"))
    wide = one.groupBy(*keys)
    wide = wide.pivot(names, list(columns)) if columns is not None else wide.pivot(names)
    return wide.agg(F.first("__v"))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing numbers to 0 in the listed columns."""
    return df.na.fill(0, list(cols))


def gather(
    df: DataFrame,
    ids: Sequence[str],
    names: str = "name",
    values: str = "value",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Wide to long: one row per id and column."""
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, names, values)


def complete(df: DataFrame, sample: str, taxon: str, value: str) -> DataFrame:
    """Every sample with every taxon, 0 where the taxon was not found.

    The result is the product of samples and taxa by definition; the other
    operators work on the long table without the zeros. A missing sample or
    taxon is one of its own. The optimizer decides which list is shipped.
    """
    cells = df.select(sample).distinct().crossJoin(df.select(taxon).distinct())
    found = df.groupBy(sample, taxon).agg(F.sum(value).alias(value))
    joined = natural_join(cells, found, "left", [sample, taxon])
    return joined.select(sample, taxon, F.coalesce(F.col(value), F.lit(0)).alias(value))

"""Sorting and stacking tables. Missing values sort last in both directions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.operators.joins import _ordered


def sort_na_last(df: DataFrame, keys: Sequence[str], descending: bool | Sequence[bool] = False) -> DataFrame:
    flags = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
    return df.orderBy(
        *[
            F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_last()
            for k, d in zip(keys, flags, strict=True)
        ]
    )


def sorted_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return sort_na_last(df.select(*cols).distinct(), cols)


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def rbind(*dfs: DataFrame) -> DataFrame:
    """Stack tables that have the same columns, in any order."""
    for d in dfs[1:]:
        if set(d.columns) != set(dfs[0].columns):
            raise ValueError("the tables have different columns")
    return reduce(lambda a, b: a.unionByName(b), dfs)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that sorts first by ``order``, missing values last;
    remaining ties are broken by the other columns.

    An aggregation, so a key with very many rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    by = [*order, *[c for c in rest if c not in order]]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(row, _ordered(by)).alias("__row"))
    cols = {c: F.col("__row")[c] for c in rest}
    return picked.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])

"""Row filters. Conditions that are NULL drop the row, as in SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.functions.numbers import to_number
from seston.operators.joins import natural_join


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows missing any of the columns."""
    return df.na.drop(subset=list(cols))


def filter_null(df: DataFrame, col: str) -> DataFrame:
    """Keep rows where the column is missing."""
    return df.filter(F.col(col).isNull())


def any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with a missing value in any (listed) column."""
    return df.filter(reduce(or_, [F.col(f"`{c}`").isNull() for c in cols or df.columns]))


def keep_in(df: DataFrame, keys: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose key occurs in ``keys``; a missing key matches a missing key."""
    return natural_join(df, keys, "semi", on)


def keep_not_in(df: DataFrame, keys: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose key does not occur in ``keys``."""
    return natural_join(df, keys, "anti", on)


def drop_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop the rows named by a table of composite keys."""
    return natural_join(df, keys, "anti", keys.columns)


def exclude_taxa(df: DataFrame, names: Sequence[str], col: str = "taxon") -> DataFrame:
    """Drop the named taxa; rows without a name are kept."""
    return df.filter(~F.coalesce(F.col(col).isin(*names), F.lit(False)))


def drop_nondetects(df: DataFrame, flag: str, result: str) -> DataFrame:
    """Drop results flagged as not detected (flag other than 0) and read the
    remaining results as numbers."""
    return df.filter(F.col(flag) == 0).withColumn(result, to_number(result))

"""Numeric column expressions with explicit rules for missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str, kind: str = "double") -> Column:
    """Text to number; text that is not a number becomes NULL."""
    parsed = as_col(c).try_cast(kind)
    if kind in ("double", "float"):
        return F.when(~F.isnan(parsed), parsed)
    return parsed


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """``top / bottom``, NULL where the divisor is zero."""
    bottom = as_col(bottom)
    return as_col(top) / F.when(bottom != 0, bottom)


def round_to(c: Column | str, digits: int = 0, ties: str = "up") -> Column:
    """Round decimals; ``ties`` is "up" (away from zero) or "even"."""
    if ties not in ("up", "even"):
        raise ValueError(f"ties must be 'up' or 'even', not {ties!r}")
    return (F.round if ties == "up" else F.bround)(as_col(c), digits)


def row_count_present(cols: Sequence[str]) -> Column:
    """How many of the columns hold a value in this row."""
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def row_sum(cols: Sequence[str], na: str = "skip") -> Column:
    """Sum across columns. "skip" treats NULL as 0; "propagate" gives NULL."""
    if na not in ("skip", "propagate"):
        raise ValueError(f"na must be 'skip' or 'propagate', not {na!r}")
    total = None
    for c in cols:
        term = F.col(c).cast("double")
        term = F.coalesce(term, F.lit(0.0)) if na == "skip" else term
        total = term if total is None else total + term
    return total


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the values present in this row; NULL if there are none."""
    return ratio(row_sum(cols), row_count_present(cols))


def with_row_mean(df: DataFrame, new: str, cols: Sequence[str], mode: str = "row") -> DataFrame:
    """Add the mean over ``cols``.

    ``mode="row"`` is the mean of each row. ``mode="global"`` puts the one mean
    over all rows and columns on every row; it exists for parity with analyses
    that did so by accident.
    """
    if mode == "row":
        return df.withColumn(new, row_mean(cols))
    if mode != "global":
        raise ValueError(f"mode must be 'row' or 'global', not {mode!r}")
    grand = df.agg(
        ratio(F.sum(row_sum(cols)), F.sum(row_count_present(cols))).alias("m")
    )
    return df.withColumn(new, grand.scalar())


def power_of_ten_steps(low: float, high: float, cells: int) -> list[float]:
    """Round-numbered edges covering [low, high] in about ``cells`` cells.

    Steps are 1, 2, 5 or 10 times a power of ten. The step is the largest one
    still preferred when a coarser step is penalised 1.5 times as much as a
    finer one (2.75 times for step 5).
    """
    import math

    if not cells or cells < 1:
        raise ValueError("cells must be at least 1")
    span = high - low
    if span <= 0:
        span = abs(high) or 1.0
        low, high = low - span / 2, high + span / 2
    cell = span / cells
    base = 10.0 ** math.floor(math.log10(cell))
    step = base
    for factor, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if factor * base - cell >= bias * (cell - step):
            break
        step = factor * base
    first = math.floor(low / step + 1e-7)
    last = math.ceil(high / step - 1e-7)
    return [k * step for k in range(first, last + 1)]

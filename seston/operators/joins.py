"""Joins in which a missing key matches a missing key.

All are equi-joins, so the optimizer chooses broadcast or shuffle from the
sizes it knows and splits skewed partitions while running. No side is forced
to be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seston.sources.small import small_table

_HOW = {"left": "left", "inner": "inner", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def _full(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full join as a left join and the rows of the right without a partner.

    A full outer join can neither be broadcast nor have a hot key split while
    it runs; both parts of this can, and the second needs only distinct keys.
    """
    known = left.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    matched = natural_join(left, right, "left", keys)
    alone = natural_join(right, known, "anti", keys)
    return matched.unionByName(alone, allowMissingColumns=True)


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns both sides have, in the order of the left."""
    keys = [c for c in left.columns if c in set(right.columns)]
    if not keys:
        raise ValueError("the tables share no column")
    return keys


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "left", on: Sequence[str] | None = None
) -> DataFrame:
    """Join on all shared columns, or on ``on``; each key appears once.

    ``how`` is left, inner, full, semi or anti. With ``on``, other columns the
    sides share are an error rather than silently doubled.
    """
    if how not in _HOW:
        raise ValueError(f"how must be one of {sorted(_HOW)}, not {how!r}")
    keys = list(on) if on else natural_keys(left, right)
    renamed = {k: f"__right_{k}" for k in keys}
    if how in ("semi", "anti"):
        right = right.select(*keys)
    else:
        clash = (set(left.columns) & set(right.columns)) - set(keys)
        if clash:
            raise ValueError(f"columns on both sides but not keys: {sorted(clash)}")
    if how == "full":
        return _full(left, right, keys)
    right = right.withColumnsRenamed(renamed)
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{renamed[k]}`")) for k in keys])
    joined = left.join(right, same, _HOW[how])
    return joined if how in ("semi", "anti") else joined.drop(*renamed.values())


def _ordered(cols: Sequence[str]) -> Column:
    """Sort key over columns, missing values last."""
    fields = []
    for i, c in enumerate(cols):
        fields += [F.col(f"`{c}`").isNull().alias(f"n{i}"), F.col(f"`{c}`").alias(f"v{i}")]
    return F.struct(*fields)


def unique_by(df: DataFrame, keys: Sequence[str], on_dup: str = "error") -> DataFrame:
    """One row per key. "error" fails at run time if a key repeats; "first"
    keeps the row that sorts first; "distinct" drops exact copies and fails if
    a key then still repeats."""
    rest = [c for c in df.columns if c not in keys]
    if on_dup not in ("error", "first", "distinct"):
        raise ValueError(f"on_dup must be error, first or distinct, not {on_dup!r}")
    if on_dup == "distinct":
        df = df.distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(True)
    pick = F.min_by(row, _ordered(rest)) if rest else F.first(row)
    grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        pick.alias("__row"), F.count(F.lit(1)).alias("__n")
    )
    if on_dup != "first":
        grouped = grouped.withColumn(
            "__row",
            F.when(F.col("__n") == 1, F.col("__row")).otherwise(
                F.raise_error(
                    F.concat(
                        F.lit(f"duplicate lookup key {list(keys)}: "),
                        F.concat_ws(", ", *[F.col(f"`{k}`").cast("string") for k in keys]),
                    )
                )
            ),
        )
    cols = [F.col(f"`{k}`") for k in keys]
    if rest:
        cols += [F.col("__row")[c].alias(c) for c in rest]
    elif on_dup != "first":
        grouped = grouped.filter("__row")
    return grouped.select(*cols).select(*df.columns)


def join_lookup(
    df: DataFrame,
    dim: DataFrame,
    keys: Sequence[str] | None = None,
    on_dup: str = "error",
    how: str = "left",
) -> DataFrame:
    """Join a lookup table without ever multiplying rows; see ``unique_by``."""
    keys = list(keys) if keys else natural_keys(df, dim)
    return natural_join(df, unique_by(dim, keys, on_dup), how, keys)


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side with a ``found_in`` label: both, left or right."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    found = sides.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side = F.when(F.col("l") == 0, "right").when(F.col("r") == 0, "left").otherwise("both")
    return found.select(*keys, side.alias("found_in"))


def apply_corrections(
    df: DataFrame, patch: DataFrame, keys: Sequence[str], col: str, new: str | None = None
) -> DataFrame:
    """Replace ``col`` where the key is listed in ``patch``, else keep it.

    ``patch`` holds the keys and the new value (column ``new``, or the one
    column that is not a key). The corrected column may itself be a key.
    """
    value = new or next(c for c in patch.columns if c not in keys)
    small = unique_by(patch.select(*keys, F.col(value).alias("__new")), list(keys))
    fixed = natural_join(df, small, "left", keys)
    return fixed.withColumn(col, F.coalesce(F.col("__new"), F.col(col))).drop("__new")


def enrich_with_fallback(
    df: DataFrame,
    primary: DataFrame,
    fallback: DataFrame,
    primary_keys: Sequence[str],
    fallback_keys: Sequence[str],
    on_dup: str = "first",
) -> DataFrame:
    """Add the columns of ``primary`` where its key matches, else those of
    ``fallback``, and ``matched`` = primary, fallback or none.

    A row takes all its values from one source. One pass over ``df``.
    """
    p_vals = [c for c in primary.columns if c not in primary_keys]
    f_vals = [c for c in fallback.columns if c not in fallback_keys]
    p = primary.select(*primary_keys, F.struct(*p_vals).alias("__p"))
    f = fallback.select(*fallback_keys, F.struct(*f_vals).alias("__f"))
    out = natural_join(df, unique_by(p, list(primary_keys), on_dup), "left", primary_keys)
    out = natural_join(out, unique_by(f, list(fallback_keys), on_dup), "left", fallback_keys)
    hit = F.col("__p").isNotNull()
    cols: dict[str, Column] = {}
    for c in dict.fromkeys(p_vals + f_vals):
        from_p = F.col("__p")[c] if c in p_vals else F.lit(None)
        from_f = F.col("__f")[c] if c in f_vals else F.lit(None)
        cols[c] = F.when(hit, from_p).otherwise(from_f)
    cols["matched"] = (
        F.when(hit, "primary").when(F.col("__f").isNotNull(), "fallback").otherwise("none")
    )
    return out.withColumns(cols).drop("__p", "__f")


def _merged(periods: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping periods of a group joined into one."""
    w = W.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    run = F.sum("__fresh").over(w.rowsBetween(W.unboundedPreceding, 0))
    return (
        periods.select(*by, start, end)
        .withColumn("__fresh", fresh)
        .withColumn("__run", run)
        .groupBy(*by, "__run")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
    )


def in_period(
    df: DataFrame,
    periods: DataFrame,
    by: str | Sequence[str],
    date: str,
    start: str = "start",
    end: str = "end",
    label: str | None = None,
) -> DataFrame:
    """Mark rows that fall in a dated period of their group.

    Adds ``in_period`` (true/false), one row per row of ``df``; or, with
    ``label``, that column of the period (NULL outside every period), and then
    a row inside overlapping periods appears once for each. Both end dates
    belong to the period; a period without a start or an end is ignored.
    """
    by = [by] if isinstance(by, str) else list(by)
    p = periods.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    if not label:
        p = _merged(p, by, start, end)
    cols = [F.col(b).alias(f"__by_{b}") for b in by]
    cols += [F.col(start).alias("__start"), F.col(end).alias("__end")]
    if label:
        cols.append(F.col(label))
    p = p.select(*cols)
    cond = [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by]
    cond.append(F.col(date).between(F.col("__start"), F.col("__end")))
    out = df.join(p, reduce(and_, cond), "left")
    if not label:
        out = out.withColumn("in_period", F.col("__start").isNotNull())
    return out.drop("__start", "__end", *[f"__by_{b}" for b in by])


def code_labels(df: DataFrame, col: str, labels: Mapping[str, str], new: str) -> DataFrame:
    """Add labels for codes from a mapping, through a lookup join."""
    dim = small_table(df.sparkSession, list(labels.items()), f"`{col}` string, `{new}` string")
    return join_lookup(df, dim, [col])

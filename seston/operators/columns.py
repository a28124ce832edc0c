"""Choosing, naming, ordering, casting, splitting and joining columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.functions.numbers import to_number


def _span(columns: Sequence[str], item: str) -> list[str]:
    """Expand "a:c" to the columns from a to c in their present order."""
    if item in columns or ":" not in item:
        if item not in columns:
            raise KeyError(f"no column {item!r}")
        return [item]
    first, last = item.split(":", 1)
    i, j = columns.index(first), columns.index(last)
    step = 1 if i <= j else -1
    return [columns[k] for k in range(i, j + step, step)]


def expand_columns(df: DataFrame, spec: Sequence[str]) -> list[str]:
    out: list[str] = []
    for item in spec:
        out += [c for c in _span(df.columns, item) if c not in out]
    return out


def select_cols(df: DataFrame, *spec: str | Mapping[str, str]) -> DataFrame:
    """Select columns by name, by range "a:c", renamed {"new": "old"}, or
    dropped "-a" / "-a:c". If every item drops, the rest is kept."""
    kept: list[tuple[str, str]] = []
    if all(isinstance(s, str) and s.startswith("-") for s in spec):
        kept = [(c, c) for c in df.columns]
    for item in spec:
        if isinstance(item, Mapping):
            kept += [(old, new) for new, old in item.items()]
        elif item.startswith("-"):
            gone = set(_span(df.columns, item[1:]))
            kept = [p for p in kept if p[0] not in gone]
        else:
            have = {p[0] for p in kept}
            kept += [(c, c) for c in _span(df.columns, item) if c not in have]
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in kept])


def select_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Select columns by 1-based position."""
    if any(not 1 <= p <= len(df.columns) for p in positions):
        raise IndexError(f"positions must lie in 1..{len(df.columns)}")
    return df.select(*[F.col(f"`{df.columns[p - 1]}`") for p in positions])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename {"old": "new"}; an unknown old name is an error."""
    unknown = set(names) - set(df.columns)
    if unknown:
        raise KeyError(f"no columns {sorted(unknown)}")
    return df.withColumnsRenamed(dict(names))


def relocate(
    df: DataFrame, cols: Sequence[str], after: str | None = None, before: str | None = None
) -> DataFrame:
    """Move columns (names or ranges) next to another; to the front by default."""
    moved = expand_columns(df, cols)
    rest = [c for c in df.columns if c not in moved]
    if after and before:
        raise ValueError("give after or before, not both")
    if after:
        at = rest.index(after) + 1
    elif before:
        at = rest.index(before)
    else:
        at = 0
    return df.select(*[F.col(f"`{c}`") for c in rest[:at] + moved + rest[at:]])


def map_columns(
    df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]
) -> DataFrame:
    """Replace each listed column (names or ranges) by ``fn`` of it."""
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in expand_columns(df, cols)})


def cast_columns(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cast text columns; a value that does not fit becomes NULL."""
    return df.withColumns({c: to_number(F.col(f"`{c}`"), k) for c, k in kinds.items()})


def unite(
    df: DataFrame, new: str, cols: Sequence[str], sep: str = "_", remove: bool = False
) -> DataFrame:
    """Join columns into one text; missing values are left out."""
    joined = df.withColumn(new, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))
    return joined.drop(*[c for c in cols if c != new]) if remove else joined


def separate(
    df: DataFrame,
    col: str,
    into: Sequence[str],
    sep: str = "[^A-Za-z0-9]+",
    keep: bool = False,
) -> DataFrame:
    """Split text at a pattern into named columns. Too few pieces leave NULL
    on the right, extra pieces are dropped."""
    pieces = F.split(F.col(col), sep)
    out = df.withColumns(
        {f"__{name}": F.get(pieces, F.lit(i)) for i, name in enumerate(into)}
    )
    if not keep:
        out = out.drop(col)
    out = out.drop(*[n for n in into if n in out.columns])
    return out.withColumnsRenamed({f"__{n}": n for n in into})


def _words(name: str) -> list[str]:
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    text = text.replace("'", "").replace('"', "").replace("%", " percent ").replace("#", " number ")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    text = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", text)
    return [w.lower() for w in re.findall(r"[A-Za-z0-9]+", text)] or ["x"]


def clean_name(name: str, case: str = "snake") -> str:
    words = _words(name)
    if words[0][0].isdigit():
        words[0] = "x" + words[0]
    if case == "snake":
        return "_".join(words)
    if case == "big_camel":
        return "".join(w[:1].upper() + w[1:] for w in words)
    raise ValueError(f"case must be 'snake' or 'big_camel', not {case!r}")


def clean_names(df: DataFrame, case: str = "snake") -> DataFrame:
    """Plain, unique column names; repeats get _2, _3, ..."""
    out: list[str] = []
    for name in df.columns:
        base = clean_name(name, case)
        unique, k = base, 1
        while unique in out:
            k += 1
            unique = f"{base}_{k}"
        out.append(unique)
    return df.toDF(*out)

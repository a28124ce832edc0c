"""Text column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seston.functions.numbers import as_col


def replace_all(c: Column | str, pattern: str, replacement: str, fixed: bool = False) -> Column:
    """Replace every occurrence; ``fixed`` takes the pattern as plain text."""
    c = as_col(c)
    if fixed:
        return F.replace(c, F.lit(pattern), F.lit(replacement))
    return F.regexp_replace(c, pattern, replacement)


def replace_each(
    c: Column | str, pairs: Sequence[tuple[str, str]] | Mapping[str, str], fixed: bool = True
) -> Column:
    """Apply replacements one after another, in the order given."""
    out = as_col(c)
    for old, new in pairs.items() if isinstance(pairs, Mapping) else pairs:
        out = replace_all(out, old, new, fixed)
    return out


def tidy_space(c: Column | str) -> Column:
    """Non-breaking spaces to plain ones, outer blanks off, empty to NULL."""
    clean = F.trim(F.regexp_replace(as_col(c), "\u00a0", " "))
    return F.when(clean != "", clean)


def sentence_case(c: Column | str) -> Column:
    """First letter upper case, every other letter lower case."""
    c = as_col(c)
    rest = c.substr(F.lit(2), F.length(c))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(rest))


def from_end(c: Column | str, start: int, end: int = -1) -> Column:
    """Characters ``start``..``end``, both counted from the end (-1 is last)."""
    if not start <= end < 0:
        raise ValueError("need start <= end < 0")
    c = as_col(c)
    size = F.length(c)
    first = F.greatest(size + start + 1, F.lit(1))
    last = size + end + 1
    return c.substr(first, F.greatest(last - first + 1, F.lit(0)))


def any_of(patterns: str | Sequence[str], ignore_case: bool = False, fixed: bool = False) -> str:
    """One regular expression matching any of the patterns."""
    parts = [patterns] if isinstance(patterns, str) else list(patterns)
    parts = [re.escape(p) for p in parts] if fixed else parts
    return ("(?i)" if ignore_case else "") + "|".join(parts)


def matches(
    c: Column | str, patterns: str | Sequence[str], ignore_case: bool = False, fixed: bool = False
) -> Column:
    """True where the text contains a pattern. A missing text is False, so the
    negation keeps missing texts."""
    return F.coalesce(as_col(c).rlike(any_of(patterns, ignore_case, fixed)), F.lit(False))


def classify_text(
    c: Column | str, rules: Sequence[tuple[str, str]], default: str | None = None
) -> Column:
    """Label of the first (pattern, label) rule found, ignoring case."""
    out = None
    for pattern, label in rules:
        hit = matches(c, pattern, ignore_case=True)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default).cast("string"))


# Quality and debris words looked for in free-text comments.
QUALITY_RULES = [("degraded", "degraded"), ("fragment", "fragmented")]
DEBRIS_RULES = [("high", "high"), ("moderate", "moderate"), ("low", "low")]


def quality_class(c: Column | str) -> Column:
    return classify_text(c, QUALITY_RULES, "good")


def debris_level(c: Column | str) -> Column:
    return classify_text(c, DEBRIS_RULES)


def taxon_level(species: Column | str) -> Column:
    """"genus" for an unresolved species ("sp.", "spp."), else "species"."""
    return F.when(matches(species, r"spp?\.", ignore_case=True), "genus").otherwise("species")


def split_last(c: Column | str) -> tuple[Column, Column]:
    """Text before and after the last space; without a space both are the text."""
    c = as_col(c)
    spaced = c.contains(" ")
    head = F.when(spaced, F.regexp_extract(c, "^(.*) (.*)$", 1)).otherwise(c)
    tail = F.when(spaced, F.regexp_extract(c, "^(.*) (.*)$", 2)).otherwise(c)
    return head, tail


def relabel(c: Column | str, labels: Mapping[str, str], default: str | None = None) -> Column:
    """Map codes to labels. Codes not listed keep their value, or take
    ``default`` if one is given."""
    c = as_col(c)
    out = None
    for code, label in labels.items():
        out = F.when(c == code, F.lit(label)) if out is None else out.when(c == code, F.lit(label))
    return out.otherwise(c if default is None else F.lit(default))


def level_order(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in a level list; NULL for values outside it."""
    found = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.when(found > 0, found)

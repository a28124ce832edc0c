"""Concentrations, volumes and densities as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seston.functions.numbers import as_col, ratio, round_to

ML_PER_M3 = 1_000_000


def concentration(
    units: Column | str,
    chamber_area: Column | str,
    volume: Column | str,
    field_area: Column | str,
    fields: Column | str,
    digits: int | None = 1,
) -> Column:
    """Counted units per mL: units scaled from the fields seen to the chamber,
    per volume analysed."""
    per_ml = ratio(
        as_col(units) * as_col(chamber_area),
        as_col(volume) * as_col(field_area) * as_col(fields),
    )
    return per_ml if digits is None else round_to(per_ml, digits)


def biovolume(
    cells: Column | str,
    mean_cell_volume: Column | str,
    chamber_area: Column | str,
    volume: Column | str,
    field_area: Column | str,
    fields: Column | str,
    digits: int | None = 1,
) -> Column:
    """Cell volume per mL: cell concentration times mean volume of a cell."""
    return concentration(
        as_col(cells) * as_col(mean_cell_volume), chamber_area, volume, field_area, fields, digits
    )


def analysed_share(received: Column | str, analysed: Column | str) -> Column:
    """Share of the received volume that was analysed."""
    return ratio(analysed, received)


def tow_volume(submerged: Column | str, length: Column | str, radius: float = 0.15) -> Column:
    """Water filtered by one net tow: mouth area x share submerged x length."""
    return F.lit(radius**2 * math.pi) * as_col(submerged) * as_col(length)


def total_tow_volume(
    submerged: Sequence[str], length: Sequence[str], radius: float = 0.15, na: str = "propagate"
) -> Column:
    """Sum over tows; "skip" counts a missing tow as none."""
    total = None
    for s, n in zip(submerged, length, strict=True):
        term = tow_volume(s, n, radius)
        term = F.coalesce(term, F.lit(0.0)) if na == "skip" else term
        total = term if total is None else total + term
    return total


def density(
    count: Column | str,
    category: Column | str,
    pairs: Mapping[str, tuple[str, str]],
    default: tuple[str, str],
    tow_m3: Column | str,
) -> Column:
    """Individuals per mL of water.

    ``pairs`` names, for a category, the (subsample mL, bottle mL) columns its
    count refers to; other categories use ``default``.
    """

    def scaled(cols: tuple[str, str]) -> Column:
        aliquot, bottle = cols
        return ratio(count, ratio(aliquot, bottle))

    whole = None
    for label, cols in pairs.items():
        hit = as_col(category) == label
        whole = F.when(hit, scaled(cols)) if whole is None else whole.when(hit, scaled(cols))
    whole = scaled(default) if whole is None else whole.otherwise(scaled(default))
    return ratio(whole, as_col(tow_m3) * ML_PER_M3)


__all__ = [
    "analysed_share",
    "biovolume",
    "concentration",
    "density",
    "total_tow_volume",
    "tow_volume",
]

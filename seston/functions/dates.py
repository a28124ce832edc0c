"""Dates, clock times and zoned timestamps from text and spreadsheet numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seston.functions.numbers import as_col, to_number

# The two layouts met in the inputs, and day 0 of spreadsheets.
DATE_LAYOUTS = ("yyyy-MM-dd", "M/d/yyyy")
SPREADSHEET_DAY_ZERO = "1899-12-30"


def parse_date(c: Column | str, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """Date by the first layout that fits; NULL if none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(as_col(c), F.lit(f))) for f in layouts])


def spreadsheet_date(c: Column | str) -> Column:
    """Spreadsheet day number (text or number) to date."""
    days = F.floor(to_number(c)).cast("int")
    return F.date_add(F.lit(SPREADSHEET_DAY_ZERO).cast("date"), days)


def spreadsheet_seconds(c: Column | str) -> Column:
    """Fraction of a day (text or number) to whole seconds since midnight."""
    return F.round(to_number(c) * 86400.0).cast("long")


def clock_seconds(c: Column | str) -> Column:
    """"H:mm" or "H:mm:ss" to seconds since midnight; anything else NULL."""
    c = as_col(c)
    parts = F.split(c, ":")
    at = [F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0)) for i in range(3)]
    seconds = at[0] * 3600 + at[1] * 60 + at[2]
    shaped = c.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")
    return F.when(shaped, seconds)


def clock_text(seconds: Column | str) -> Column:
    """Seconds since midnight to "HH:mm:ss"."""
    s = as_col(seconds).cast("long")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(s / 3600).cast("int"),
        F.floor(s % 3600 / 60).cast("int"),
        (s % 60).cast("int"),
    )


def instant(date: Column | str, seconds: Column | str, zone: str) -> Column:
    """Local date and time of day in a named zone to a timestamp.

    The result does not depend on the session zone. A time inside a
    daylight-saving gap moves forward by the length of the gap; a time that
    occurs twice means the first occurrence.
    """
    d, s = as_col(date), as_col(seconds).cast("long")
    return F.try_make_timestamp(
        F.year(d),
        F.month(d),
        F.dayofmonth(d),
        F.floor(s / 3600).cast("int"),
        F.floor(s % 3600 / 60).cast("int"),
        (s % 60).cast("decimal(16,6)"),
        F.lit(zone),
    )


def local_text(ts: Column | str, zone: str) -> Column:
    """Wall-clock text of an instant in a named zone, assuming a UTC session."""
    return F.date_format(F.from_utc_timestamp(as_col(ts), zone), "yyyy-MM-dd HH:mm:ss")


def season(month: Column | str) -> Column:
    """Season code of a month number: W, Sp, Su, F."""
    m = as_col(month).cast("int")
    return (
        F.when(m.isin(12, 1, 2), "W")
        .when(m.isin(3, 4, 5), "Sp")
        .when(m.isin(6, 7, 8), "Su")
        .when(m.isin(9, 10, 11), "F")
    )

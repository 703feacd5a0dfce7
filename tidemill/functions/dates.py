"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(c, "MM")


def season_order(month: Column) -> Column:
    """1 to 4, the southern summer first: December to February, March to May, and so on."""
    return (F.floor((month % 12) / 3) + 1).cast("int")


def season_name(order: Column) -> Column:
    """Name of a southern season by its order."""
    return F.element_at(F.array(*map(F.lit, ["Summer", "Autumn", "Winter", "Spring"])), order)


def season_year(year: Column, month: Column) -> Column:
    """The year a season counts for: December belongs to the next."""
    return year + (month == 12).cast("int")


def local_time(instant: Column, zone: str = "America/Sao_Paulo") -> Column:
    """Wall-clock time of an instant in a zone."""
    return F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), zone).cast("timestamp_ntz")


def decade(year: Column) -> Column:
    """1990 for 1990 to 1999."""
    return (F.floor(year / 10) * 10).cast("int")


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, each cut to whole seconds first, so fractions never count a boundary."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def whole_minutes_apart(a: Column, b: Column) -> Column:
    """Absolute distance in whole minutes, cut off."""
    return F.floor(F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(60_000_000)).cast("long")


def year_of_partial_date(c: Column) -> Column:
    """The year that a text such as `1997`, `1997-05` or `1997-05-21` starts with; NULL for others."""
    return F.when(c.rlike("^[0-9]{4}"), F.substring(c, 1, 4).cast("int"))

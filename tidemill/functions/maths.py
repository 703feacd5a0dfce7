"""Arithmetic that gives NULL where the reference tables have none, and rounds alike in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL for b = 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Half up by floor, which all engines do alike on doubles."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(a: Column, b: Column, digits: int = 4) -> Column:
    """100 * a / b, rounded."""
    return rounded(F.lit(100.0) * ratio(a, b), digits)


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; NULL where both are 0 or NULL."""
    return F.try_divide(F.lit(2.0) * precision * recall, precision + recall)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the values that aren't NULL, by weight; NULL where all are."""
    top = sum((F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in parts), F.lit(0.0))
    bottom = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.try_divide(top, bottom)

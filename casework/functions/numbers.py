"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back, as numpy does (0.125 -> 0.12, 0.375 -> 0.38)."""
    scale = float(10**digits)
    # adding 0.0 turns a negative zero into zero
    return F.rint(value.cast("double") * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage of *whole*, 0 when there is nothing to divide by."""
    percent = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.when(whole > 0, round_even(percent, digits)).otherwise(F.lit(0.0))

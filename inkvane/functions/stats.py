"""Ratios with a defined value where the denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or the given value where b is 0."""
    return F.when(b == 0, F.lit(float(otherwise))).otherwise(a / F.when(b != 0, b))


def variation(m: Column, s: Column) -> Column:
    """Coefficient of variation; 0 for a mean of 0."""
    return ratio(s, F.abs(m))


def burstiness(m: Column, s: Column) -> Column:
    """(s - m) / (s + m); 0 for a denominator of 0."""
    return ratio(s - m, s + m)

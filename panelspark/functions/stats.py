"""Closed forms of survey statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(yes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval as shares; NULL for n = 0."""
    p, z2 = yes / F.nullif(n, F.lit(0)), z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), (mid - half) / (1 + z2 / n)), F.least(F.lit(1.0), (mid + half) / (1 + z2 / n))


def standard_error(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))


def detectable_difference(p: Column, n: Column, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """The least difference of two groups of n that the power can show."""
    return (z_alpha + z_power) * F.sqrt(2 * p * (1 - p) / F.nullif(n, F.lit(0)))


def corr_guarded(x: Column | str, y: Column | str, least: int = 5) -> Column:
    """Pearson's correlation over rows where both are known; NULL below ``least`` rows or without variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when((F.count(a) >= least) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b)), F.corr(a, b))

"""Interval columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """(low, high) of the Wilson score interval, within 0 and 1; (0, 1) without cases."""
    k = F.greatest(n, F.lit(1)).cast("double")
    p, z2 = hits / k, z * z
    middle, spread = p + z2 / (2 * k), z * F.sqrt(p * (1 - p) / k + z2 / (4 * k * k))
    low, high = (middle - spread) / (1 + z2 / k), (middle + spread) / (1 + z2 / k)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(high, F.lit(1.0))).otherwise(1.0)

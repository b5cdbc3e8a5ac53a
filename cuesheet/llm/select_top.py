"""The k-th largest of many keys, by four passes over 16 bits of the key each; at most 65536 counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kth_largest(rows: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of the long column ``key`` (nulls don't count), or None if there are fewer values."""
    rest = rows.select(F.col(key).alias("_key")).filter("_key is not null")
    prefix = None
    for shift in (48, 32, 16, 0):
        part = rest if prefix is None else rest.filter(F.shiftright("_key", shift + 16) == prefix)
        counts = sorted(((r[0], r[1]) for r in part.groupBy(F.shiftright("_key", shift)).count().collect()), reverse=True)
        for prefix, n in counts:
            if n >= k:
                break
            k -= n
        else:
            return None
    return prefix

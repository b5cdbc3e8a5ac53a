"""Vector columns: array<float> or array<double>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if a vector has no length, null if one is null; vectors of unequal size raise."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    unequal = F.raise_error(F.concat(F.lit("vectors of sizes "), F.size(a), F.lit(" and "), F.size(b))).cast("double")
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), unequal).when(length == 0, 0.0).otherwise(dot(a, b) / length)


def parse_vector(text: Column) -> Column:
    """"[0.1,0.2]" as array<float>; null or blank is null."""
    inner = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.when(F.coalesce(F.length(inner), F.lit(0)) > 0, F.split(inner, ",").cast("array<float>"))


def print_vector(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))

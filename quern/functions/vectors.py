"""Vector expressions, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is next to nothing."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size < 1e-9), F.lit(0.0)).otherwise(dot(a, b) / size)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    raised = F.transform(a, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)

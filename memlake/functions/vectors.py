"""Vector columns.  Vectors are float arrays; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 for missing, empty, unequal-length or zero vectors."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    scale = norm(a) * norm(b)
    return F.when(usable, F.when(scale > 0, dot(a, b) / scale).otherwise(-1.0)).otherwise(-1.0)

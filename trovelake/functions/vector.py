"""Vector scalars over ARRAY<DOUBLE> columns, as higher-order SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot_product(left: Column, right: Column) -> Column:
    """Dot product over the common prefix (a longer vector's tail counts as zero)."""
    return _sum(F.zip_with(left, right, lambda a, b: F.coalesce(a * b, F.lit(0.0))))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine; 0 when either vector is empty or has zero length."""
    scale = l2_norm(left) * l2_norm(right)
    return F.when(scale > 0, dot_product(left, right) / scale).otherwise(F.lit(0.0))


def squared_distance(left: Column, right: Column) -> Column:
    diff = F.zip_with(
        left, right, lambda a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))
    )
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)

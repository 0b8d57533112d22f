"""Dense vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; raises on a length mismatch, NaN for a zero vector."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when(norm == 0, F.lit(float("nan"))).otherwise(_dot(a, b) / norm)
    return F.when(
        F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")
    ).otherwise(value)

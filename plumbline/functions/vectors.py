"""Vectors as Columns of ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """Components as doubles, negative zero as zero, so that equal vectors are equal arrays."""
    return F.transform(v, lambda x: x.cast("double") + F.lit(0.0))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def all_zero(v: Column) -> Column:
    return (F.size(v) > 0) & F.forall(v, lambda x: x == 0)


def norm(v: Column) -> Column:
    """Euclidean norm, scaled by the largest component: neither overflows nor underflows."""
    start = F.struct(F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0)).alias("peak"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        v,
        start,
        lambda s, x: F.struct(s["peak"].alias("peak"), (s["sum"] + (x / F.nullif(s["peak"], F.lit(0.0))) * (x / F.nullif(s["peak"], F.lit(0.0)))).alias("sum")),
        lambda s: F.when(s["peak"] == 0, 0.0).otherwise(s["peak"] * F.sqrt(s["sum"])),
    )


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def beyond_tolerance(a: Column, b: Column, tolerance: float = 2e-5) -> Column:
    """Whether two vectors differ in length, hold nonfinite values or differ by more in a component."""
    far = F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(F.isnan(x) | F.isnan(y) | (F.abs(x - y) > tolerance), F.lit(True))), lambda x: x)
    return F.coalesce((F.size(a) != F.size(b)) | ~finite(a) | ~finite(b) | far, F.lit(True))

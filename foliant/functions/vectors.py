"""Vectors as arrays of numbers: products, lengths and checks, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def not_finite(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def fault(v: Column, dim: int | None = None) -> Column:
    """Why a vector can't be searched: null if it can."""
    out = F.when(v.isNull(), F.lit("null")).when(not_finite(v), F.lit("not finite")).when(norm(v) == 0, F.lit("no length"))
    return out.when(F.size(v) != dim, F.lit("dimension")) if dim else out


def unit(v: Column) -> Column:
    own = norm(v)
    return F.transform(v, lambda x: x.cast("double") / own)

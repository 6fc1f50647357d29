"""Vectors as array columns: int8 quantisation, unit length, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIMENSIONS = 2048


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v at unit length, as doubles; null for a null or all-zero vector."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def usable(v: Column) -> Column:
    """1 to 2048 finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) >= 1) & (F.size(v) <= MAX_DIMENSIONS) & finite & F.exists(v, lambda x: x != 0)


def scale_of(v: Column) -> Column:
    """Step of the int8 form: the largest magnitude over 127; null for unusable vectors."""
    return F.when(usable(v), F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127.0)


def quantised(v: Column, scale: Column) -> Column:
    """Signed bytes, rounded half away from zero."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int"))).cast("tinyint"))


def dequantised(q: Column, scale: Column) -> Column:
    """Unit vector of a quantised one."""
    return unit(F.transform(q, lambda x: x.cast("double") * scale))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of unit vectors, within 0 and 2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - dot(a, b)))

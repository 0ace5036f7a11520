"""Small array helpers on Columns (windows are arrays of at most W values)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """Bind an expression once and use it several times."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, total(arr) / F.size(arr))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def back(arr: Column, k: int) -> Column:
    """k-th value from the end (1 = last), NULL when the array is shorter."""
    return F.get(arr, F.size(arr) - k)


def sorted_quantile(arr: Column, p: float) -> Column:
    """Quantile of a sorted array, linear between neighbours; NULL for an empty one."""
    at = F.lit(float(p)) * (F.size(arr) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(arr, low), F.get(arr, F.least(low + 1, F.size(arr) - 1))
    return F.when(F.size(arr) > 0, a + (b - a) * (at - low))


def tail(arr: Column, k: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - k + 1, F.lit(1)), F.lit(k))


def positions(arr: Column, lost: int) -> Column:
    """0-based positions of an array that is ``lost`` elements shorter."""
    return F.when(F.size(arr) > lost, F.sequence(F.lit(0), F.size(arr) - lost - 1)).otherwise(
        F.array().cast("array<int>"))


def deltas(arr: Column) -> Column:
    return F.transform(positions(arr, 1), lambda i: F.get(arr, i + 1) - F.get(arr, i))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def divide(num: Column, den: Column, tol: float) -> Column:
    """num / den, NULL where |den| < tol."""
    return F.when(F.abs(den) >= tol, num / den)


def ols(x: Column, y: Column) -> Column:
    """Least-squares line of y on x as STRUCT<slope, intercept>; NULL slope when
    fewer than two points or constant x."""
    return let(F.struct(mean(x).alias("mx"), mean(y).alias("my")), lambda m: let(
        F.struct(
            total(F.zip_with(x, y, lambda p, q: (p - m["mx"]) * (q - m["my"]))).alias("sxy"),
            total(F.transform(x, lambda p: (p - m["mx"]) * (p - m["mx"]))).alias("sxx"),
            m["mx"].alias("mx"), m["my"].alias("my")),
        lambda s: let(F.when((F.size(x) >= 2) & (s["sxx"] > 0), s["sxy"] / s["sxx"]), lambda b: F.struct(
            b.alias("slope"), (s["my"] - b * s["mx"]).alias("intercept")))))

"""Column functions on ``array<double>`` vectors; all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    """The vector in double precision: cast before any arithmetic."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalized(v: Column) -> Column:
    """v / ||v||; NULL for a zero vector."""
    return F.transform(v, lambda x: F.try_divide(x, norm(v)))


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def channel_standardized(v: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std per channel, with fixed constants."""
    m, s = F.lit([float(x) for x in mean]), F.lit([float(x) for x in std])
    return F.transform(v, lambda x, i: (x - F.get(m, i)) / F.get(s, i))


def adaptive_avg_pooled(v: Column, m: int) -> Column:
    """m bins over n numbers; bin i averages [floor(i n / m), ceil((i + 1) n / m))."""
    n = F.size(v)

    def mean_of(i: Column) -> Column:
        low = F.floor(i * n / m).cast("int")
        high = F.ceil((i + 1) * n / m).cast("int")
        return total(F.slice(v, low + 1, high - low)) / (high - low)

    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), mean_of)


def rounded(v: Column, digits: int = 6) -> Column:
    # adding 0.0 turns a negative zero into zero
    return F.transform(v, lambda x: F.round(x, digits) + 0.0)

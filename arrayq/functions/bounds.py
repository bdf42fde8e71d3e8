"""Ranges and error bounds as column expressions.

``lo`` and ``hi`` are the smallest and largest value of an array.  An array is worked on in [-1, 1], so an
error bound of that domain is twice the one relative to the range.
"""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the bound of the next finer level is multiplied with, level by level.
LEVEL_RATIO = 0.95
#: Share of the bound that coefficients are quantized with.
COEFFICIENT_RATIO = 0.1


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def value_range(df: DataFrame, value: str = "x") -> Column:
    """struct(lo, hi, n) of the non-null values as a scalar subquery: one row, made by partial aggregation."""
    v = F.col(value).cast("double")
    return df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))).scalar()


def normalize(x: Column, lo: Column, hi: Column) -> Column:
    """Into [-1, 1]; an array of one value becomes 0."""
    return F.when(hi > lo, 2.0 * (x - lo) / (hi - lo) - 1.0).otherwise(F.when(x.isNotNull(), F.lit(0.0)))


def denormalize(y: Column, lo: Column, hi: Column) -> Column:
    return (y + 1.0) * (hi - lo) / 2.0 + lo


def unit_bound(mode: str, bound, lo: Column, hi: Column) -> Column:
    """Error bound in the [-1, 1] domain from ``rel`` or ``abs``; null for an absolute one of a constant array."""
    if mode == "rel":
        return 2.0 * num(bound)
    if mode == "abs":
        return F.when(hi > lo, 2.0 * num(bound) / (hi - lo))
    raise ValueError(f"unknown bound mode {mode}")


def absolute_bound(mode: str, lo: Column, hi: Column, *, abs=None, rel=None, psnr=None, norm=None, n=None) -> Column:
    """Error bound in the array's own unit, from one of abs, rel, psnr, norm, abs_and_rel, abs_or_rel."""
    if mode == "abs":
        return num(abs)
    if mode == "rel":
        return num(rel) * (hi - lo)
    if mode == "psnr":
        return (hi - lo) * F.pow(F.lit(10.0), (num(psnr) + 10 * log10(1 - 2 / 3 * 0.99)) / -20.0)
    if mode == "norm":
        return F.sqrt(3.0 / n) * num(norm)
    if mode == "abs_and_rel":
        return F.least(num(abs), num(rel) * (hi - lo))
    if mode == "abs_or_rel":
        return F.greatest(num(abs), num(rel) * (hi - lo))
    raise ValueError(f"unknown bound mode {mode}")


def level_bound(bound, level: Column, ratio: float = LEVEL_RATIO) -> Column:
    return num(bound) * F.pow(F.lit(ratio), level)

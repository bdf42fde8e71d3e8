"""One-dimensional interpolation formulas over neighbour columns, in the order of their positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the neighbours and what their sum is divided by.
WEIGHTS = {
    "linear": ((1, 1), 2),
    "linear1": ((-1, 3), 2),
    "quad_1": ((3, 6, -1), 8),
    "quad_2": ((-1, 6, 3), 8),
    "quad_3": ((3, -10, 15), 8),
    "cubic": ((-1, 9, 9, -1), 16),
    "cubic_front": ((5, 15, -5, 1), 16),
    "cubic_front_2": ((1, 6, -4, 1), 4),
    "cubic_back_1": ((1, -5, 15, 5), 16),
    "cubic_back_2": ((-5, 21, -35, 35), 16),
    "cubic2": ((-3, 23, 23, -3), 40),
}


def weighted(values: list[Column], weights) -> Column:
    """Sum of the weighted neighbours; null if one is missing."""
    total = F.lit(0.0)
    for v, w in zip(values, weights, strict=True):
        total = total + v * (w if isinstance(w, Column) else float(w))
    return total


def formula(name: str, *values: Column) -> Column:
    weights, by = WEIGHTS[name]
    return weighted(list(values), weights) / float(by)


def mean(*values: Column) -> Column:
    return weighted(list(values), [1] * len(values)) / float(len(values))


#: Fixed value: bend below which Akima's weights say nothing.
FLAT = 1e-9


def akima(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Akima's cubic at the middle of b and c, from four neighbours: each end's slope weighs its two secants by how little the other side bends."""
    s, t = 2 * b - a - c, 2 * c - b - d
    bend = F.abs(s) + F.abs(t)
    return (b + c) / 2 + F.when(bend > FLAT, (s * F.abs(t) + t * F.abs(s)) / 8 / bend).otherwise(F.lit(0.0))


def pchip(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The monotone cubic at the middle of b and c: an end's slope is the harmonic mean of its two secants, 0 where these differ in sign."""
    half = lambda s, t: F.when(s * t > 0, s * t / (s + t)).otherwise(F.lit(0.0))
    return (b + c) / 2 + (half(b - a, c - b) - half(c - b, d - c)) / 4

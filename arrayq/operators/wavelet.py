"""Periodic Daubechies wavelet of four coefficients along a long axis.

A level is one job: each value goes to the two averages and the two details that it is part of, and these are summed
by place.  The averages, half as many, are written to the shared folder and go through the next level, so that all levels
together move twice the first one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import saved

#: The low-pass filter; the high-pass filter is the same backwards with alternating signs.
LOW = tuple(v / (4 * 2**0.5) for v in (1 + 3**0.5, 3 + 3**0.5, 3 - 3**0.5, 1 - 3**0.5))
HIGH = tuple((-1) ** j * LOW[3 - j] for j in range(4))


def padded_size(n: int) -> int:
    """The power of two, 2 at least, that n places are padded to."""
    return 1 << max(1, (n - 1).bit_length())


def _check(size: int, levels: int | None) -> int:
    if size < 2 or size & (size - 1):
        raise ValueError(f"{size} is no power of two from 2 on")
    most = size.bit_length() - 1
    if levels is not None and not 0 <= levels <= most:
        raise ValueError(f"{size} places have {most} levels, not {levels}")
    return most if levels is None else levels


def _pick(odd: Column, even_value: float, odd_value: float) -> Column:
    return F.when(odd, odd_value).otherwise(even_value)


def forward(df: DataFrame, size: int, levels: int | None = None) -> DataFrame:
    """(i, x): coefficients of df(i, x), 0 <= i < size, a power of two; missing places and nulls are zero.

    After ``levels`` levels (default: all) the averages are at the first size / 2 ** levels places, and the details of
    level l fill size / 2 ** l up to twice that.  Places whose coefficient has no value under it are left out.
    """
    odd = F.col("i") % 2 == 1
    rows, out = df.select("i", F.col("x").cast("double").alias("x")).where("x is not null"), None
    for _ in range(_check(size, levels)):
        half = size // 2
        sent = [F.struct(F.pmod(F.expr(f"i div 2 - {k}"), F.lit(half)).cast("long").alias("k"), (_pick(odd, LOW[2 * k], LOW[2 * k + 1]) * F.col("x")).alias("a"), (_pick(odd, HIGH[2 * k], HIGH[2 * k + 1]) * F.col("x")).alias("d")) for k in (0, 1)]
        both = saved(rows.select(F.explode(F.array(*sent)).alias("s")).groupBy("s.k").agg(F.sum("s.a").alias("a"), F.sum("s.d").alias("d")))
        details = both.select((F.col("k") + half).alias("i"), F.col("d").alias("x"))
        out = details if out is None else out.unionByName(details)
        rows, size = both.select(F.col("k").alias("i"), F.col("a").alias("x")), half
    return rows if out is None else out.unionByName(rows)


def backward(coefficients: DataFrame, size: int, levels: int | None = None) -> DataFrame:
    """(i, x): the values that forward() made coefficients(i, x) of; missing places are zero."""
    rows = coefficients.select("i", "x")
    for level in range(_check(size, levels), 0, -1):
        n = size >> (level - 1)
        high = F.col("i") >= n // 2
        sent = [F.struct(F.expr(f"(2 * (i % {n // 2}) + {j}) % {n}").cast("long").alias("i"), (F.when(high, HIGH[j]).otherwise(LOW[j]) * F.col("x")).alias("x")) for j in range(4)]
        merged = rows.where(F.col("i") < n).select(F.explode(F.array(*sent)).alias("s")).groupBy("s.i").agg(F.sum("s.x").alias("x"))
        rows = saved(merged).unionByName(rows.where(F.col("i") >= n))
    return rows

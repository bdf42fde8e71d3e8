"""Parameter sweeps: result tables keyed by data set, bound and codec."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("dataset", "rel_eb", "codec")


def bound_label(eb: Column) -> Column:
    """Display form of a bound, such as 1.0e-03; tables are keyed by the number itself."""
    return F.format_string("%.1e", eb)


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of a few short parameter lists, each of one column, as a chain of explodes."""
    out = axes[0]
    for a in axes[1:]:
        c = a.columns[0]
        out = out.withColumn(c, F.explode(a.agg(F.sort_array(F.collect_set(c))).scalar()))
    return out


def missing(wanted: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What no complete result is recorded for."""
    return wanted.join(done.where(F.col("cr").isNotNull() & F.col("psnr").isNotNull()), list(keys), "left_anti")


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """table with the rows of new in place of those with equal keys; a null in new leaves the recorded value."""
    values = [c for c in table.columns if c not in keys]
    both = table.join(new.withColumnsRenamed({c: f"__{c}" for c in values}), list(keys), "full")
    return both.select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in values))


def merged(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, cr, psnr, blocks) of blocks(by, cr, mse, lo, hi): harmonic mean of the ratios, PSNR of the mean error over the whole range."""
    a = blocks.groupBy(*by).agg(F.count("*").alias("blocks"), F.sum(1 / F.col("cr")).alias("s"), F.avg("mse").alias("mse"), (F.max("hi") - F.min("lo")).alias("range"))
    return a.select(*by, (F.col("blocks") / F.col("s")).alias("cr"), psnr(F.col("range"), F.col("mse")).alias("psnr"), "blocks")


def psnr(value_range: Column, mse: Column) -> Column:
    return F.when(mse > 0, 20 * F.log10(value_range) - 10 * F.log10(mse))


def mse_of_psnr(value_range: Column, p: Column) -> Column:
    return value_range * value_range * F.pow(F.lit(10.0), -p / 10)


def wide(sweep: DataFrame, codecs: Sequence[str]) -> DataFrame:
    """One row for each data set and bound, columns <codec>_CR and <codec>_PSNR; a missing result is null."""
    pick = lambda c, v: F.max(F.when(F.col("codec") == c, F.col(v)))
    return sweep.groupBy("dataset", "rel_eb").agg(*(pick(c, v).alias(f"{c}_{v.upper()}") for c in codecs for v in ("cr", "psnr")))


def best(sweep: DataFrame, by: Sequence[str], parameter: str, value: str = "cr") -> DataFrame:
    """The row of largest value of each group, the smallest parameter among equals."""
    return sweep.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v"), parameter)).alias("b")).select(*by, f"b.{parameter}", (-F.col("b.v")).alias(value))


def nearest(sweep: DataFrame, by: Sequence[str], target: float, parameter: str = "rel_eb", value: str = "cr") -> DataFrame:
    """The row of each group whose value is nearest to the target: what a bisection on the parameter would look for, over one grid."""
    return sweep.groupBy(*by).agg(F.min(F.struct(F.abs(F.col(value) - target).alias("d"), parameter, value)).alias("b")).select(*by, f"b.{parameter}", f"b.{value}")


def middle(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row at n div 2, counted from 0, of each group."""
    w = Window.partitionBy(*by)
    return df.withColumns({"__r": F.row_number().over(w.orderBy(*order)), "__n": F.count("*").over(w)}).where(F.expr("__r = __n div 2 + 1")).drop("__r", "__n")


def bisected(evaluate, low: float, high: float, target: float, tolerance: float = 0.01, most: int = 20) -> tuple[float, float]:
    """(bound, value): geometric bisection of a growing function to within ``tolerance`` of the target, at most ``most`` evaluations, each a Spark job."""
    found = []
    for _ in range(most):
        mid = (low * high) ** 0.5
        value = evaluate(mid)
        found.append((abs(value - target), mid, value))
        if found[-1][0] <= tolerance * target:
            break
        low, high = (mid, high) if value < target else (low, mid)
    return min(found)[1:]

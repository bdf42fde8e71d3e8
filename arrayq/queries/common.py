"""What the queries share: tables as arrays, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bounds as B
from ..operators import arrays as A

#: Error bound in [-1, 1] (1e-2 of the range), cells of a 1-D block, columns of the 2-D and 3-D foldings.
BOUND, BLOCK, WIDTH, CUBE = 0.02, 100, 100, (10, 10)

SIGNAL = "s as (select event_id as i, value as x from events)"
NORM = "r as (select min(value) as lo, max(value) as hi from events), s as (select event_id as i, 2e0 * (value - lo) / (hi - lo) - 1 as x from events, r)"
PLANE = f"{NORM}, a as (select i // {WIDTH} as i0, i % {WIDTH} as i1, x from s)"
SPACE = f"{NORM}, a as (select i // {CUBE[0] * CUBE[1]} as i0, i // {CUBE[1]} % {CUBE[0]} as i1, i % {CUBE[1]} as i2, x from s)"


def R(x: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {digits}) + 0e0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("i"), F.col("value").alias("x"))


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf)
    r = B.value_range(s)
    return s.select("i", B.normalize(F.col("x"), r["lo"], r["hi"]).alias("x"))


def plane(spark: SparkSession, sf: str) -> DataFrame:
    return A.fold(normalized(spark, sf), (0, WIDTH)).select("i0", "i1", "x")


def space(spark: SparkSession, sf: str) -> DataFrame:
    return A.fold(normalized(spark, sf), (0, *CUBE)).select("i0", "i1", "i2", "x")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


#: Columns of metrics.report() over x and y.
REPORT = f"""count(*) as n, {R("max(abs(y - x))")} as max_err, {R("max(abs(y - x)) / (max(x) - min(x))")} as max_rel_err, {R("max(case when x <> 0 then abs(y - x) / abs(x) end)")} as max_pointwise_rel,
    {R("avg((y - x) * (y - x))")} as mse, {R("20 * log10(max(x) - min(x)) - 10 * log10(avg((y - x) * (y - x)))")} as psnr, {R("sqrt(avg((y - x) * (y - x))) / (max(x) - min(x))")} as nrmse,
    {R("sqrt(sum((y - x) * (y - x)))")} as norm_err, {R("sqrt(sum((y - x) * (y - x))) / sqrt(sum(y * y))")} as norm_err_rel, {R("corr(x, y)")} as correlation"""

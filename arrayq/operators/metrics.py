"""Quality and size measures: grouped aggregates, and windows only over small histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions.bounds import num
from .arrays import named, shifted


def report(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Error measures of y against x, for each group or the whole.  Rows where either is null are left out."""
    e = F.col(y) - F.col(x)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(F.abs(e)).alias("max_err"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("__s"), F.sum(F.col(y) * F.col(y)).alias("__y"),
        (F.max(x) - F.min(x)).alias("range"), F.max(F.when(F.col(x) != 0, F.abs(e) / F.abs(x))).alias("max_pointwise_rel"), F.corr(x, y).alias("correlation"),
    )
    psnr = F.when(F.col("mse") > 0, 20 * F.log10("range") - 10 * F.log10("mse"))
    return a.select(
        *by, "n", "max_err", (F.col("max_err") / F.nullif("range", F.lit(0.0))).alias("max_rel_err"), "max_pointwise_rel", "mse", psnr.alias("psnr"), (F.sqrt("mse") / F.nullif("range", F.lit(0.0))).alias("nrmse"),
        F.sqrt("__s").alias("norm_err"), F.try_divide(F.sqrt("__s"), F.sqrt("__y")).alias("norm_err_rel"), "correlation",
    )


def lag1_autocorrelation(df: DataFrame, value: str = "x", index: str = "i") -> DataFrame:
    """One row: mean of neighbouring products of deviations over the population variance; 0 for a constant series."""
    m = df.agg(F.avg(value)).scalar()
    rows = shifted(df.select(index, F.col(value).alias("x")), [1], index=index)
    d, nxt = F.col("x") - m, F.col(named("x", 1)) - m
    a = rows.agg(F.avg(d * d).alias("var"), F.avg(d * nxt).alias("cov"))
    return a.select(F.when(F.col("var") == 0, 0.0).otherwise(F.col("cov") / F.col("var")).alias("autocorrelation"))


def histogram(df: DataFrame, code: str = "code", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, code).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, symbols, bits): bits a symbol that an order-0 coder needs at least; from a histogram, by log2 N - sum(n log2 n) / N."""
    a = counts.groupBy(*by).agg(F.sum("n").alias("__t"), F.count("*").alias("symbols"), F.sum(F.col("n") * F.log2("n")).alias("__s"))
    return a.select(*by, F.col("__t").alias("n"), "symbols", (F.log2("__t") - F.col("__s") / F.col("__t")).alias("bits"))


def run_lengths(df: DataFrame, code: str = "code", index: str = "i", block: int = 4096) -> DataFrame:
    """(begin, code, length) of maximal runs of equal codes at consecutive indices.

    Runs are found inside blocks of the index; the pieces at block edges, at most two a block, are then joined up the same way.
    """
    rows = shifted(df.select(index, F.col(code).alias("c")), [-1], values=["c"], index=index, block=block)
    new = F.col(named("c", -1)).isNull() | (F.col(named("c", -1)) != F.col("c"))
    in_block = Window.partitionBy("b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    b = F.floor(F.col(index) / block).alias("b")
    # a run that crosses into a block is a piece of its own there, without a begin
    pieces = rows.select(index, "c", b, new.alias("new")).withColumn("k", F.sum(F.col("new").cast("int")).over(in_block))
    pieces = pieces.groupBy("b", "k").agg(F.min(index).alias("begin"), F.first("c").alias("code"), F.count("*").alias("length"), F.max("new").alias("opens"))
    # blocks that one run covers whole have no begin; the run they belong to is the last begun before, found over one row a block
    last = pieces.groupBy("b").agg(F.max(F.when(F.col("opens"), F.struct("begin", "code"))).alias("last"))
    groups = last.select("b", "last", F.floor(F.col("b") / block).alias("g"))
    inside = groups.select("b", "g", F.last("last", True).over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    above = groups.groupBy("g").agg(F.max("last").alias("last")).select("g", F.last("last", True).over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    origin = inside.join(above, "g").select("b", F.coalesce("before", "far").alias("origin"))
    joined = pieces.join(origin, "b").select(F.when(F.col("opens"), F.col("begin")).otherwise(F.col("origin.begin")).alias("begin"), "code", "length")
    return joined.groupBy("begin", "code").agg(F.sum("length").alias("length"))


def frame_stats(df: DataFrame, by: Sequence[str], x: str = "x") -> DataFrame:
    """Mean, median, spread, extremes, mean of the non-zero values and percentage of zeros for each frame."""
    v = F.col(x)
    return df.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(F.when(v != 0, v)).alias("mean_nonzero"), (F.avg((v == 0).cast("double")) * 100).alias("sparsity"),
    )


def ratio(original_bytes: Column, compressed_bytes: Column) -> Column:
    return original_bytes.cast("double") / compressed_bytes


def coded_bits(counts: DataFrame) -> DataFrame:
    """(code, n, bits): histogram with the length of each code word by Shannon's rule, ceil(-log2 p), which a prefix code can have."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(total / F.col("n"))).cast("int")))


def mean_bin(df: DataFrame, e: float, x: str = "x") -> DataFrame:
    """(bin, n): the densest pair of adjacent bins of width e around the mean of the values, as its left bin; the first of equal ones."""
    m = df.agg(F.avg(x)).scalar()
    d = F.col(x) - m
    bins = df.select(F.when(d > 0, F.floor(d / e)).otherwise(F.ceil(d / e) - 1).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    pairs = bins.unionByName(bins.select((F.col("bin") - 1).alias("bin"), "n")).groupBy("bin").agg(F.sum("n").alias("n"))
    return pairs.agg(F.min(F.struct((-F.col("n")).alias("n"), "bin")).alias("p")).select("p.bin", (-F.col("p.n")).alias("n"))


def quantization_intervals(df: DataFrame, e: float, share: float = 0.999, most: int = 8192, x: str = "x", pred: str = "pred") -> DataFrame:
    """One row: the smallest power of two of intervals, 32 at least, for which the codes cover more than ``share`` of the residuals."""
    k = F.least(F.floor((F.abs(F.col(pred) - F.col(x)) / e + 1) / 2), F.lit(most - 1)).cast("long")
    counts = df.select(k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    # at most ``most`` rows in one window
    running = counts.select("k", F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    first = running.agg(F.coalesce(F.min(F.when(F.col("sum") > F.floor(F.col("total") * share), F.col("k"))), F.lit(most - 1)).alias("k"))
    return first.select(F.greatest(F.lit(32), 2 * F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * (F.col("k") + 1)))).cast("long")).cast("long").alias("intervals"))


def predictability(df: DataFrame, axis: str, by: Sequence[str], x: str = "x") -> DataFrame:
    """One row (axis, mse): how well odd cells are the mean of their two neighbours on the axis."""
    rows = shifted(df, [-1, 1], by, axis, [x])
    e = (F.col(named(x, -1)) + F.col(named(x, 1))) / 2 - F.col(x)
    return rows.where(F.col(axis) % 2 == 1).agg(F.lit(axis).alias("axis"), F.avg(e * e).alias("mse"))


def codes_of(df: DataFrame, e, x: str = "x", pred: str = "pred") -> DataFrame:
    return df.withColumn("code", Q.toward_zero(F.col(x) - F.col(pred), e))


def effective_rank(df: DataFrame, vector: str, share: float = 0.95, scaled: bool = False) -> DataFrame:
    """One row (rank, dimensions): how many principal components explain ``share`` of the variance.

    Rows with null vectors are left out.  The covariance is summed by Spark; what comes to the driver is dimensions x dimensions numbers.
    scaled: columns are divided by their spread first; constant ones count as zero.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    if scaled:
        rows = StandardScaler(inputCol="v", outputCol="s").fit(rows).transform(rows).select(F.col("s").alias("v"))
    first = rows.first()
    if first is None:
        return df.sparkSession.createDataFrame([], "rank int, dimensions int")
    explained, total, rank = PCA(k=len(first["v"]), inputCol="v").fit(rows).explainedVariance.toArray(), 0.0, 0
    while rank < len(explained) and total < share - 1e-12:
        total += float(explained[rank])
        rank += 1
    return df.sparkSession.createDataFrame([(rank, len(explained))], "rank int, dimensions int")


def bound_share(loss: Column, e) -> Column:
    """Root of the mean squared loss in units of a quantization bin, 2 * e."""
    return F.sqrt(loss) / (2 * num(e))

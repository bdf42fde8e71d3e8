"""Predictors over coordinate tables: neighbour formulas, block regression, ridge fits and the choice among them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import num
from ..functions.quantize import toward_zero
from .arrays import axes, gathered, named, shifted

RIDGE = 1e-4


def lorenzo_offsets(ndim: int, layers: int = 1) -> dict[tuple[int, ...], int]:
    """Weights of the corners behind a cell: -prod(w) with w = (-1, 1) or (-1, 2, -1) along each axis, without the cell itself."""
    w = {1: (1, -1), 2: (1, -2, 1)}[layers]
    return {tuple(-k for k in at): -int(np.prod([w[k] for k in at])) for at in product(range(layers + 1), repeat=ndim) if any(at)}


def lorenzo(df: DataFrame, ndim: int, layers: int = 1) -> DataFrame:
    """(i0.., x, pred) by inclusion and exclusion of previous corners; those outside the array are 0."""
    weights = lorenzo_offsets(ndim, layers)
    if ndim == 1:
        out = shifted(df.withColumnRenamed("i0", "i"), [o[0] for o in weights]).withColumnRenamed("i", "i0")
        pred = sum((F.coalesce(named_col("x", o[0]), F.lit(0.0)) * float(w) for o, w in weights.items()), F.lit(0.0))
    else:
        out = gathered(df, ndim, list(weights))
        pred = sum((F.coalesce(F.col(f"n{k}"), F.lit(0.0)) * float(w) for k, w in enumerate(weights.values())), F.lit(0.0))
    return out.select(*axes(ndim), "x", pred.alias("pred"))


def named_col(value: str, offset: int) -> Column:
    return F.col(named(value, offset))


def no_prediction(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", F.lit(0.0))


def previous_frame(df: DataFrame, by: Sequence[str], time: str, value: str = "x") -> DataFrame:
    """pred: the same particle's value one frame before, that of frame 0 itself being 0."""
    return shifted(df, [-1], by, time, [value]).withColumn("pred", F.coalesce(named_col(value, -1), F.lit(0.0))).drop(named(value, -1))


def block_regression_1d(df: DataFrame, size: int) -> DataFrame:
    """(block, slope, intercept, n): the least-squares line of each block over the place in it."""
    p = F.col("i") % size
    return df.groupBy(F.expr(f"i div {size}").alias("block")).agg(F.regr_slope("x", p).alias("slope"), F.regr_intercept("x", p).alias("intercept"), F.count("x").alias("n"))


def block_regression(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(b0.., c0.., intercept): the plane of each full block; on a full grid axes are uncorrelated, so each slope is a covariance over a variance."""
    n = len(sizes)
    b = df.withColumns({f"b{k}": F.expr(f"i{k} div {s}") for k, s in enumerate(sizes)} | {f"p{k}": (F.col(f"i{k}") % s).cast("double") for k, s in enumerate(sizes)})
    slopes = [F.covar_pop("x", f"p{k}") / F.var_pop(f"p{k}") for k in range(n)]
    agg = b.groupBy(*(f"b{k}" for k in range(n))).agg(*(s.alias(f"c{k}") for k, s in enumerate(slopes)), F.avg("x").alias("__m"), *(F.avg(f"p{k}").alias(f"__p{k}") for k in range(n)), F.count("*").alias("n"))
    intercept = F.col("__m")
    for k in range(n):
        intercept = intercept - F.col(f"c{k}") * F.col(f"__p{k}")
    return agg.select(*(f"b{k}" for k in range(n)), *(f"c{k}" for k in range(n)), intercept.alias("intercept"), "n")


def quadratic_1d(df: DataFrame, size: int) -> DataFrame:
    """(block, c0, c1, c2): the least-squares parabola of each full block over t = place scaled to [-1, 1]; t is orthogonal to 1 and t * t."""
    t = (F.col("i") % size) * (2.0 / (size - 1)) - 1.0
    m = df.select(F.expr(f"i div {size}").alias("block"), t.alias("t"), (t * t).alias("q"), "x").groupBy("block").agg(
        (F.covar_pop("x", "t") / F.var_pop("t")).alias("c1"), (F.covar_pop("x", "q") / F.var_pop("q")).alias("c2"), F.avg("x").alias("m"), F.avg("q").alias("mq"), F.count("*").alias("n")
    ).where(F.col("n") == size)
    return m.select("block", (F.col("m") - F.col("c2") * F.col("mq")).alias("c0"), "c1", "c2")


def best_per_group(errors: DataFrame, keys: Sequence[str], name: str = "predictor", error: str = "err") -> DataFrame:
    """The candidate of least error of each group; of equal ones the first by name."""
    return errors.groupBy(*keys).agg(F.min(F.struct(error, name)).alias("__b")).select(*keys, f"__b.{name}", f"__b.{error}")


def gram(df: DataFrame, keys: Sequence[str], xs: Sequence[Column], y: Column) -> DataFrame:
    """(keys, n, a, b): upper triangle of the sums of products of the regressors, and with y, row by row; one row for each group."""
    k = len(xs)
    rows = df.select(*keys, *(x.cast("double").alias(f"__x{i}") for i, x in enumerate(xs)), y.cast("double").alias("__y"))
    a = [F.coalesce(F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")), F.lit(0.0)) for i in range(k) for j in range(i, k)]
    b = [F.coalesce(F.sum(F.col(f"__x{i}") * F.col("__y")), F.lit(0.0)) for i in range(k)]
    return rows.groupBy(*keys).agg(F.count("__y").alias("n"), F.array(*a).alias("a"), F.array(*b).alias("b"))


def solve(sums: DataFrame, base: Sequence[float], ridge: float = RIDGE) -> DataFrame:
    """sums with the column w: coefficients of the ridge fit towards ``base``, from gram(); batches of small systems are solved at once."""
    k, base = len(base), np.asarray(base, float)
    upper = np.triu_indices(k)
    names = [c for c in sums.columns if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = len(t)
            if not n:
                continue
            m = np.zeros((n, k, k))
            m[:, upper[0], upper[1]] = t.column("a").flatten().to_numpy().reshape(n, -1)
            m = np.maximum(m, 0) + np.minimum(m, 0)
            m = m + np.transpose(np.triu(m, 1), (0, 2, 1))
            w = np.linalg.solve(m + ridge**2 * np.eye(k), (t.column("b").flatten().to_numpy().reshape(n, k) + ridge**2 * base)[:, :, None])[:, :, 0]
            cols = [t.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1)), k).cast(pa.list_(pa.float64()))], [*names, "w"])

    kinds = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in names)
    return sums.mapInArrow(run, f"{kinds}, w array<double>")


def ridge_2(sums: DataFrame, base: Sequence[float], ridge: float = RIDGE) -> DataFrame:
    """solve() for two regressors, as an expression."""
    r = ridge**2
    a, b, d = (F.element_at("a", i + 1) + (0.0 if i == 1 else r) for i in range(3))
    p, q = (F.element_at("b", i + 1) + r * base[i] for i in range(2))
    det = a * d - b * b
    return sums.withColumn("w", F.array((d * p - b * q) / det, (a * q - b * p) / det)).drop("a", "b")


def applied(w: Column, xs: Sequence[Column]) -> Column:
    """Sum of products, held in [-1, 1]."""
    total = sum((F.element_at(w, i + 1) * x for i, x in enumerate(xs)), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))


def robust_fit(df: DataFrame, keys: Sequence[str], xs: Sequence[Column], y: Column, base: Sequence[float], limit=None, ridge: float = RIDGE, gap: int = 1, order: Column | None = None) -> DataFrame:
    """(keys, n, w): ridge fit; with ``limit``, refitted on the equations that the first fit misses by no more than that.

    A group without such equations keeps ``base``.  gap: only every gap-th equation, by ``order``, a dense number within the group, is fitted.
    """
    two = len(base) == 2
    fit = (lambda s: ridge_2(s, base, ridge)) if two else (lambda s: solve(s, base, ridge))
    rows = df if gap == 1 else df.where(order % gap == 0)
    first = fit(gram(rows, keys, xs, y))
    if limit is None:
        return first
    again = rows.join(first.select(*keys, F.col("w").alias("__w")), list(keys))
    miss = sum((F.element_at("__w", i + 1) * x for i, x in enumerate(xs)), F.lit(0.0)) - y
    refit = fit(gram(again.where(F.abs(miss) <= num(limit)), keys, xs, y)).select(*keys, F.col("w").alias("__w"), F.col("n").alias("__n"))
    start = F.array(*(F.lit(float(b)) for b in base))
    return first.join(refit, list(keys), "left").select(*keys, F.coalesce("__n", F.lit(0)).alias("n"), F.coalesce("__w", start).alias("w"))


def standardized_fit(df: DataFrame, keys: Sequence[str], xs: Sequence[Column], y: Column, base: Sequence[float], limit, ridge: float = 1e-7, least: int = 64) -> DataFrame:
    """(keys, n, w), the last of w being the intercept: ridge fit on z-scored regressors, filtered and refitted.

    Groups with fewer than ``least`` equations before or after the filter keep ``base``.
    """
    k = len(xs)

    def fit(rows: DataFrame) -> DataFrame:
        named_ = rows.withColumns({f"__x{i}": x for i, x in enumerate(xs)} | {"__y": y})
        stats = named_.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__y").alias("my"), *(F.avg(f"__x{i}").alias(f"m{i}") for i in range(k)), *(F.stddev_pop(f"__x{i}").alias(f"s{i}") for i in range(k)))
        z = [F.when(F.col(f"s{i}") > 0, (F.col(f"__x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(F.lit(0.0)) for i in range(k)]
        w = solve(gram(named_.join(stats, list(keys)), keys, z, F.col("__y") - F.col("my")), [0.0] * k, ridge**0.5).select(*keys, "w")
        both = stats.join(w, list(keys))
        raw = [F.when(F.col(f"s{i}") > 0, F.element_at("w", i + 1) / F.col(f"s{i}")).otherwise(F.lit(0.0)) for i in range(k)]
        start = F.col("my") - sum((r * F.col(f"m{i}") for i, r in enumerate(raw)), F.lit(0.0))
        return both.where(F.col("n") >= least).select(*keys, "n", F.array(*raw, start).alias("w"))

    first = fit(df)
    again = df.join(first.select(*keys, F.col("w").alias("__w")), list(keys))
    miss = sum((F.element_at("__w", i + 1) * x for i, x in enumerate(xs)), F.element_at("__w", k + 1)) - y
    refit = fit(again.where(F.abs(miss) <= num(limit)).drop("__w")).select(*keys, F.col("w").alias("__w"), F.col("n").alias("__n"))
    start = F.array(*(F.lit(float(b)) for b in base))
    return df.select(*keys).distinct().join(refit, list(keys), "left").select(*keys, F.coalesce("__n", F.lit(0)).alias("n"), F.coalesce("__w", start).alias("w"))


def mean_of_present(df: DataFrame, ndim: int, offsets: Sequence[Sequence[int]], value: str = "x") -> DataFrame:
    """(i0.., value, pred): mean of those neighbours that are inside the array; 0 without any."""
    there = F.filter(F.array(*(F.col(f"n{k}") for k in range(len(offsets)))), lambda v: v.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return gathered(df, ndim, offsets, value).select(*axes(ndim), value, F.when(F.size(there) > 0, total / F.size(there)).otherwise(F.lit(0.0)).alias("pred"))


def quadratic(df: DataFrame, sizes: Sequence[int], ridge: float = 1e-9) -> DataFrame:
    """(b0.., n, w): the least-squares quadric of each block over t_k, the place on axis k scaled to [-1, 1].

    w goes with 1, the t_k, and the products t_j * t_k for j <= k.  A coefficient that a block's cells don't determine is drawn to 0 by ``ridge``.
    """
    ndim = len(sizes)
    t = [(F.col(f"i{k}") % s) * (2.0 / max(1, s - 1)) - 1.0 for k, s in enumerate(sizes)]
    xs = [F.lit(1.0), *t, *(t[j] * t[k] for j in range(ndim) for k in range(j, ndim))]
    keys = [f"b{k}" for k in range(ndim)]
    return solve(gram(df.withColumns({f"b{k}": F.expr(f"i{k} div {s}") for k, s in enumerate(sizes)}), keys, xs, F.col("x")), [0.0] * len(xs), ridge)


#: What is added to the Lorenzo error, in error bounds, as its neighbours will be decoded ones; by layers and dimensions.
LORENZO_NOISE = {1: {1: 0.5, 2: 0.81, 3: 1.22}, 2: {1: 1.08, 2: 2.76, 3: 6.8}}


def on_diagonal(sizes: Sequence[int]) -> Column:
    """Whether a cell lies on one of its block's 2 ** (ndim - 1) space diagonals; with one axis, at one of its ends."""
    p = [F.col(f"i{k}") % s for k, s in enumerate(sizes)]
    if len(sizes) == 1:
        return p[0].isin(0, sizes[0] - 1)
    ok = F.lit(True)
    for x, s in zip(p[1:], sizes[1:], strict=True):
        ok = ok & ((x == p[0]) | (x == s - 1 - p[0]))
    return ok


def block_errors(df: DataFrame, sizes: Sequence[int], e: float = 0.0, mean: Column | None = None) -> DataFrame:
    """(b0.., predictor, err): summed absolute error on each full block's diagonals of Lorenzo prediction in one and two layers and of the block's plane.

    Lorenzo errors have LORENZO_NOISE bounds e added.  mean: a value that may also be taken, where it is nearer than Lorenzo prediction.
    Only cells on the diagonals ask for their neighbours; those outside the array are 0.
    """
    n = len(sizes)
    one, two = lorenzo_offsets(n, 1), lorenzo_offsets(n, 2)
    wanted = F.array(*(F.struct(*((F.col(f"i{k}") + o[k]).alias(f"j{k}") for k in range(n)), F.lit(float(one.get(o, 0))).alias("w1"), F.lit(float(w)).alias("w2")) for o, w in two.items()))
    sent = df.where(on_diagonal(sizes)).select(*axes(n), "x", F.explode(wanted).alias("t")).select(*axes(n), "x", "t.*")
    met = sent.join(df.select(*(F.col(f"i{k}").alias(f"j{k}") for k in range(n)), F.col("x").alias("v")), [f"j{k}" for k in range(n)], "left")
    v = F.coalesce("v", F.lit(0.0))
    rows = met.groupBy(*axes(n), "x").agg(F.sum(F.col("w1") * v).alias("p1"), F.sum(F.col("w2") * v).alias("p2"))
    keys = [f"b{k}" for k in range(n)]
    full = 1
    for s in sizes:
        full *= s
    planes = block_regression(df, sizes).where(F.col("n") == full).drop("n")
    rows = rows.withColumns({b: F.expr(f"i{k} div {s}") for k, (b, s) in enumerate(zip(keys, sizes, strict=True))}).join(planes, keys)
    plane = F.col("intercept")
    for k, s in enumerate(sizes):
        plane = plane + F.col(f"c{k}") * (F.col(f"i{k}") % s)
    miss = {f"lorenzo{layers}": F.abs(F.col("x") - F.col(f"p{layers}")) + e * LORENZO_NOISE[layers].get(n, 0.0) for layers in (1, 2)}
    if mean is not None:
        miss = {k: F.least(F.abs(F.col("x") - mean), m) for k, m in miss.items()}
    miss["regression"] = F.abs(F.col("x") - plane)
    # summed side by side, in one order of rows, so that predictors with the same errors are exactly equal
    sums = rows.groupBy(*keys).agg(*(F.sum(m).alias(k) for k, m in miss.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("predictor"), F.col(k).alias("err")) for k in miss)))
    return sums.select(*keys, pairs.alias("e")).select(*keys, "e.*")


def selected(df: DataFrame, sizes: Sequence[int], e: float = 0.0, mean: Column | None = None) -> DataFrame:
    """(b0.., predictor, err): the predictor of least error of each full block, as in block_errors()."""
    return best_per_group(block_errors(df, sizes, e, mean), [f"b{k}" for k in range(len(sizes))])


def frame_codes(df: DataFrame, time: str, particle: str, e: float, batch: int) -> DataFrame:
    """(batch, time, particle, method, code) of frames (time, particle, x) by every method: from the frame before, from the batch's first frame, from 0."""
    first = df.where(F.col(time) % batch == 0).select(F.expr(f"{time} div {batch}").alias("batch"), particle, F.col("x").alias("first"))
    rows = previous_frame(df, [particle], time).withColumn("batch", F.expr(f"{time} div {batch}")).join(first, ["batch", particle], "left")
    opens = F.col(time) % batch == 0
    preds = {"previous": F.col("pred"), "first": F.when(opens, F.lit(0.0)).otherwise(F.coalesce("first", F.lit(0.0))), "none": F.lit(0.0)}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("method"), toward_zero(F.col("x") - p, e).alias("code")) for k, p in preds.items())))
    return rows.select("batch", time, particle, pairs.alias("m")).select("batch", time, particle, "m.*")


def code_bits(codes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, bits): what an order-0 coder needs for all codes of a group."""
    h = codes.groupBy(*by, "code").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return h.select(*by, F.col("t").alias("n"), (F.col("t") * F.log2("t") - F.col("s")).alias("bits"))


def frame_methods(df: DataFrame, time: str, particle: str, e: float, batch: int = 10, every: int = 50, trial: int = 10) -> DataFrame:
    """(turn, method, n, bits): the method that needs least bits for the first ``trial`` frames of every ``every`` batches, and what all frames of these take by it."""
    codes = frame_codes(df, time, particle, e, batch).withColumn("turn", F.expr(f"batch div {every}"))
    tried = code_bits(codes.where(F.col(time) - F.col("turn") * (batch * every) < trial), ["turn", "method"])
    chosen = tried.groupBy("turn").agg(F.min(F.struct("bits", "method")).alias("m")).select("turn", F.col("m.method").alias("method"))
    return code_bits(codes.join(chosen, ["turn", "method"]), ["turn", "method"])

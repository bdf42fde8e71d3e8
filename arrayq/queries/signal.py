"""Queries over one-dimensional signals: ranges, bounds, quantization, prediction, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bounds as B
from ..functions import interpolate as I
from ..functions import quantize as Q
from ..operators import arrays as A
from ..operators import entropy as E
from ..operators import metrics as M
from ..operators import predict as P
from ..plans import codec, stencils
from .common import BLOCK, BOUND, NORM, REPORT, SIGNAL, R, normalized, rounded, signal, table

#: SQL of the code of a residual d with bound e, halves towards zero.
CODE = "cast(case when {d} >= 0 then ceil(({d} - {e}) / (2 * {e})) else floor(({d} + {e}) / (2 * {e})) end as bigint)"
CLAMP = "greatest(-1e0, least(1e0, {x}))"


def range_normalize(spark, sf) -> DataFrame:
    return rounded(normalized(spark, sf), "x")


def range_denormalize(spark, sf) -> DataFrame:
    s = signal(spark, sf)
    r = B.value_range(s)
    back = B.denormalize(B.normalize(F.col("x"), r["lo"], r["hi"]), r["lo"], r["hi"])
    return rounded(s.select("i", back.alias("x")), "x")


def bound_resolution(spark, sf) -> DataFrame:
    s = signal(spark, sf)
    a = s.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    lo, hi, n = F.col("lo"), F.col("hi"), F.col("n")
    f = {
        "unit_rel": B.unit_bound("rel", 1e-2, lo, hi), "unit_abs": B.unit_bound("abs", 0.5, lo, hi), "abs": B.absolute_bound("abs", lo, hi, abs=0.5), "rel": B.absolute_bound("rel", lo, hi, rel=1e-3),
        "psnr": B.absolute_bound("psnr", lo, hi, psnr=60.0), "norm": B.absolute_bound("norm", lo, hi, norm=10.0, n=n), "abs_and_rel": B.absolute_bound("abs_and_rel", lo, hi, abs=0.5, rel=1e-3), "abs_or_rel": B.absolute_bound("abs_or_rel", lo, hi, abs=0.5, rel=1e-3),
    }
    return a.select(*(F.round(v, 9).alias(f"e_{k}") for k, v in f.items()))


def level_bounds(spark, sf) -> DataFrame:
    return spark.range(16).select(F.col("id").alias("level"), F.round(B.level_bound(BOUND, F.col("id")), 9).alias("e"))


def quantize_toward_zero(spark, sf) -> DataFrame:
    return normalized(spark, sf).select("i", Q.toward_zero(F.col("x"), BOUND).alias("code"))


def quantize_away_escape(spark, sf) -> DataFrame:
    code = Q.shifted_code(F.col("x"), F.lit(0.0), 0.5, 256)
    return rounded(signal(spark, sf).select("i", code.alias("code"), Q.shifted_value(code, F.lit(0.0), F.col("x"), 0.5, 256).alias("y")), "y")


def dequantize(spark, sf) -> DataFrame:
    return rounded(normalized(spark, sf).select("i", Q.dequantize(F.lit(0.25), Q.toward_zero(F.col("x") - 0.25, BOUND), BOUND).alias("y")), "y")


def bag_histogram(spark, sf) -> DataFrame:
    """No prediction: codes of an unordered bag of values."""
    rows = P.no_prediction(table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x")))
    return M.histogram(M.codes_of(rows, 500.0))


def code_histogram(spark, sf) -> DataFrame:
    return M.histogram(quantize_toward_zero(spark, sf))


def entropy_bits(spark, sf) -> DataFrame:
    return rounded(M.entropy(code_histogram(spark, sf)), "bits")


def run_length(spark, sf) -> DataFrame:
    return M.run_lengths(normalized(spark, sf).select("i", Q.toward_zero(F.col("x"), 0.2).alias("code")))


def bit_width(spark, sf) -> DataFrame:
    return E.bit_width(quantize_away_escape(spark, sf))


def shannon_code_bits(spark, sf) -> DataFrame:
    return M.coded_bits(code_histogram(spark, sf))


def two_level(spark, sf) -> DataFrame:
    s = normalized(spark, sf).select(F.col("i").alias("i0"), "x")
    shape = (s.count(),)
    return codec.compressed(s, shape, stencils.axis_plan(shape, 2), BOUND)


def two_level_fix(spark, sf) -> DataFrame:
    return rounded(two_level(spark, sf).select(F.col("i0").alias("i"), "level", "code", "y"), "y")


def quality_report(spark, sf) -> DataFrame:
    """Closed-loop two-level prediction of a signal and its quality."""
    d = two_level(spark, sf)
    bits = M.entropy(M.histogram(d.where("code is not null"))).select("bits")
    r = M.report(d)
    return rounded(r.withColumn("bits", bits.scalar()), *[c for c in r.columns if c != "n"], "bits")


def quality_by_group(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.col("value").alias("x"), Q.dequantize(F.lit(0.0), Q.toward_zero(F.col("value") / 1000, 5e-3), 5e-3).alias("y")).withColumn("y", F.col("y") * 1000)
    r = M.report(e, by=["event_type"])
    return rounded(r, *r.columns[2:])


def lag1_autocorrelation(spark, sf) -> DataFrame:
    return rounded(M.lag1_autocorrelation(signal(spark, sf)), "autocorrelation")


def interpolation(spark, sf) -> DataFrame:
    s = A.shifted(normalized(spark, sf), [-3, -1, 1, 3]).where("i % 2 = 1")
    a, b, c, d = (F.col(A.named("x", o)) for o in (-3, -1, 1, 3))
    f = {
        "linear": I.formula("linear", b, c), "linear1": I.formula("linear1", a, b), "quad_1": I.formula("quad_1", b, c, d), "quad_2": I.formula("quad_2", a, b, c), "quad_3": I.formula("quad_3", a, b, c),
        "cubic": I.formula("cubic", a, b, c, d), "cubic_front": I.formula("cubic_front", a, b, c, d), "cubic_front_2": I.formula("cubic_front_2", a, b, c, d), "cubic_back_1": I.formula("cubic_back_1", a, b, c, d),
        "cubic_back_2": I.formula("cubic_back_2", a, b, c, d), "cubic2": I.formula("cubic2", a, b, c, d), "akima": I.akima(a, b, c, d), "pchip": I.pchip(a, b, c, d), "mean_4": I.mean(a, b, c, d),
        "weighted": I.weighted([a, b, c, d], [0.1, 0.4, 0.4, 0.1]),
    }
    return s.where(F.col(A.named("x", -3)).isNotNull() & F.col(A.named("x", 3)).isNotNull()).select("i", *(F.round(v, 6).alias(f"p_{k}") for k, v in f.items()))


_INTERP = {
    "linear": "(b + c) / 2", "linear1": "-0.5e0 * a + 1.5e0 * b", "quad_1": "(3 * b + 6 * c - d) / 8", "quad_2": "(-a + 6 * b + 3 * c) / 8", "quad_3": "(3 * a - 10 * b + 15 * c) / 8",
    "cubic": "(-a + 9 * b + 9 * c - d) / 16", "cubic_front": "(5 * a + 15 * b - 5 * c + d) / 16", "cubic_front_2": "(a + 6 * b - 4 * c + d) / 4", "cubic_back_1": "(a - 5 * b + 15 * c + 5 * d) / 16",
    "cubic_back_2": "(-5 * a + 21 * b - 35 * c + 35 * d) / 16", "cubic2": "(-3 * a + 23 * b + 23 * c - 3 * d) / 40",
    "akima": "(b + c) / 2 + case when abs(2*b-a-c) + abs(2*c-b-d) > 1e-9 then ((2*b-a-c) * abs(2*c-b-d) + (2*c-b-d) * abs(2*b-a-c)) / 8 / (abs(2*b-a-c) + abs(2*c-b-d)) else 0e0 end",
    "pchip": "(b + c) / 2 + (case when (b - a) * (c - b) > 0 then (b - a) * (c - b) / (c - a) else 0e0 end - case when (c - b) * (d - c) > 0 then (c - b) * (d - c) / (d - b) else 0e0 end) / 4", "mean_4": "(a + b + c + d) / 4", "weighted": "0.1e0 * a + 0.4e0 * b + 0.4e0 * c + 0.1e0 * d",
}


def block_regression(spark, sf) -> DataFrame:
    return rounded(P.block_regression_1d(normalized(spark, sf), BLOCK), "slope", "intercept")


def block_quadratic(spark, sf) -> DataFrame:
    return rounded(P.quadratic_1d(normalized(spark, sf), BLOCK), "c0", "c1", "c2")


def coefficient_quantize(spark, sf) -> DataFrame:
    w = P.block_regression_1d(normalized(spark, sf), BLOCK).select("block", F.array("slope", "intercept").alias("w"))
    c = w.select("block", Q.coefficients(F.col("w"), F.array(F.lit(0.0), F.lit(0.0)), 2e-3).alias("c"))
    return rounded(c.select("block", F.col("c")[0]["code"].alias("slope_code"), F.col("c")[0]["value"].alias("slope"), F.col("c")[1]["code"].alias("intercept_code"), F.col("c")[1]["value"].alias("intercept")), "slope", "intercept")


def _errors(spark, sf) -> DataFrame:
    """Absolute errors of each predictor at the two ends of each block."""
    s = normalized(spark, sf)
    line = P.block_regression_1d(s, BLOCK)
    rows = A.shifted(s, [-2, -1]).withColumns({"block": F.expr(f"i div {BLOCK}"), "p": F.col("i") % BLOCK}).where(F.col("p").isin(0, BLOCK - 1)).join(line, "block")
    one, two = (F.coalesce(A.named("x", -k), F.lit(0.0)) for k in (1, 2))
    preds = {"lorenzo1": one, "lorenzo2": 2 * one - two, "none": F.lit(0.0), "regression": F.col("intercept") + F.col("slope") * F.col("p")}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("predictor"), F.abs(F.col("x") - v).alias("err")) for k, v in preds.items())))
    return rows.select("block", pairs.alias("e")).select("block", "e.*").groupBy("block", "predictor").agg(F.sum("err").alias("err"))


def best_predictor_per_block(spark, sf) -> DataFrame:
    return rounded(P.best_per_group(_errors(spark, sf), ["block"]), "err")


def _pairs(spark, sf):
    """Odd cells with both neighbours, in blocks."""
    s = A.shifted(normalized(spark, sf), [-1, 1]).where("i % 2 = 1").select("i", "x", *(F.coalesce(A.named("x", o), F.lit(0.0)).alias(n) for o, n in ((-1, "a"), (1, "b"))))
    return s.withColumn("block", F.expr(f"i div {BLOCK}"))


def ridge_fit_k2(spark, sf) -> DataFrame:
    w = P.robust_fit(_pairs(spark, sf), ["block"], [F.col("a"), F.col("b")], F.col("x"), [0.5, 0.5])
    return rounded(w.select("block", "n", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1")), "w0", "w1")


def filtered_refit_k2(spark, sf) -> DataFrame:
    w = P.robust_fit(_pairs(spark, sf), ["block"], [F.col("a"), F.col("b")], F.col("x"), [0.5, 0.5], BOUND * codec.THRESHOLD)
    return rounded(w.select("block", "n", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1")), "w0", "w1")


def sampled_fit_k2(spark, sf) -> DataFrame:
    w = P.robust_fit(_pairs(spark, sf), ["block"], [F.col("a"), F.col("b")], F.col("x"), [0.5, 0.5], gap=4, order=F.expr(f"(i % {BLOCK}) div 2"))
    return rounded(w.select("block", "n", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1")), "w0", "w1")


def standardized_fit(spark, sf) -> DataFrame:
    w = P.standardized_fit(_pairs(spark, sf), ["block"], [F.col("a"), F.col("b"), F.col("i").cast("double")], F.col("x"), [0.5, 0.5, 0.0, 0.0], 3 * BOUND, least=8)
    return rounded(w.select("block", "n", *(F.col("w")[k].alias(f"w{k}") for k in range(4))), *(f"w{k}" for k in range(4)))


def mean_bin(spark, sf) -> DataFrame:
    return M.mean_bin(normalized(spark, sf), 2e-2)


def quantization_intervals(spark, sf) -> DataFrame:
    s = A.shifted(normalized(spark, sf), [-1]).withColumn("pred", F.coalesce(A.named("x", -1), F.lit(0.0)))
    return M.quantization_intervals(s, 1e-3)


def range_prefilter(spark, sf) -> DataFrame:
    """Values outside a range become a default."""
    return signal(spark, sf).select("i", F.when(F.col("x").between(10.0, 100.0), F.col("x")).otherwise(F.lit(-1.0)).alias("x"))


def byte_truncation(spark, sf) -> DataFrame:
    return rounded(E.truncated(signal(spark, sf), 2), "x", "y")


def huffman_bytes(spark, sf) -> DataFrame:
    packed, _ = E.huffman_packed(quantize_toward_zero(spark, sf))
    return packed.select("part", "n", "bits", F.length("content").alias("bytes"))


def _solve_sql(rows: str) -> str:
    return f"""select block, count(*) as n, ((saa + 1e-8) * 0 + (sbb + 1e-8) * (say + 1e-8 * 0.5e0) - sab * (sby + 1e-8 * 0.5e0)) / ((saa + 1e-8) * (sbb + 1e-8) - sab * sab) as w0,
        ((saa + 1e-8) * (sby + 1e-8 * 0.5e0) - sab * (say + 1e-8 * 0.5e0)) / ((saa + 1e-8) * (sbb + 1e-8) - sab * sab) as w1
        from (select block, count(*) as c, sum(a*a) as saa, sum(a*b) as sab, sum(b*b) as sbb, sum(a*x) as say, sum(b*x) as sby from {rows} group by block) group by block, saa, sab, sbb, say, sby, c""".replace("count(*) as n", "c as n").replace("((saa + 1e-8) * 0 + ", "(")


def _zfit_sql(name: str, rows: str, least: int) -> str:
    """Ridge fit of x on z-scored a, b, i for each block with enough rows, by determinants."""
    v = ("a", "b", "i")
    stats = ", ".join(f"avg({k}) as m{k}, stddev_pop({k}) as s{k}" for k in v)
    z = ", ".join(f"case when s{k} > 0 then ({k} - m{k}) / s{k} else 0e0 end as z{k}" for k in v)
    sums = ", ".join([*(f"sum(z{j} * z{k}){' + 1e-7' if j == k else ''} as {j}{k}" for n, j in enumerate(v) for k in v[n:]), *(f"sum(z{k} * (x - my)) as y{k}" for k in v)])
    columns = [("aa", "ab", "ai"), ("ab", "bb", "bi"), ("ai", "bi", "ii"), ("ya", "yb", "yi")]
    minor = lambda p, q, r: f"({p[0]} * ({q[1]} * {r[2]} - {q[2]} * {r[1]}) - {q[0]} * ({p[1]} * {r[2]} - {p[2]} * {r[1]}) + {r[0]} * ({p[1]} * {q[2]} - {p[2]} * {q[1]}))"
    det = minor(*columns[:3])
    w = ", ".join(f"case when s{k} > 0 then {minor(*(columns[3] if j == n else columns[j] for j in range(3)))} / {det} / s{k} else 0e0 end as w{n}" for n, k in enumerate(v))
    groups = "n, my, " + ", ".join(f"m{k}, s{k}" for k in v)
    return f"""{name}m as (select block, count(*) as n, avg(x) as my, {stats} from {rows} group by block), {name}z as (select block, x, {groups}, {z} from {rows} join {name}m using (block)),
        {name}g as (select block, {groups}, {sums} from {name}z group by block, {groups}), {name}w as (select *, {w} from {name}g where n >= {least}), {name} as (select block, n, w0, w1, w2, my - w0 * ma - w1 * mb - w2 * mi as w3 from {name}w)"""


_PAIRS = f"""{NORM}, o as (select i, x, coalesce(lag(x) over (order by i), 0) as a, coalesce(lead(x) over (order by i), 0) as b from s),
    q as (select *, i // {BLOCK} as block from o where i % 2 = 1)"""
_TWO = f"""{NORM}, l2 as (select i, 2 as level, cast(null as bigint) as code, x, x as y from s where i % 4 = 0),
    p1 as (select t.i, t.x, {CLAMP.format(x="0.5e0 * coalesce(a.y, 0) + 0.5e0 * coalesce(b.y, 0)")} as p, {BOUND!r}e0 * 0.95e0 as e from s t left join l2 a on a.i = t.i - 2 left join l2 b on b.i = t.i + 2 where t.i % 4 = 2),
    c1 as (select *, {CODE.format(d="(x - p)", e="e")} as code from p1), l1 as (select i, 1 as level, code, x, {CLAMP.format(x="p + 2 * e * code")} as y from c1),
    k as (select * from l2 union all select * from l1),
    p0 as (select t.i, t.x, {CLAMP.format(x="0.5e0 * coalesce(a.y, 0) + 0.5e0 * coalesce(b.y, 0)")} as p, {BOUND!r}e0 as e from s t left join k a on a.i = t.i - 1 left join k b on b.i = t.i + 1 where t.i % 2 = 1),
    c0 as (select *, {CODE.format(d="(x - p)", e="e")} as code from p0), f as (select * from k union all select i, 0, code, x, {CLAMP.format(x="p + 2 * e * code")} from c0)"""
_CODES = f"{NORM}, c as (select i, {CODE.format(d='x', e=f'{BOUND!r}e0')} as code from s)"
_AWAY = f"""{SIGNAL}, h as (select *, (cast(floor(abs(x) / 0.5e0) as bigint) + 1) // 2 * (case when x < 0 then -1 else 1 end) as q from s),
    g as (select i, x, case when floor(abs(x) / 0.5e0) + 1 < 512 and abs(q - x) <= 0.5e0 then q + 256 else 0 end as code, cast(q as double) as v from h)"""

QUERIES = {
    f.__name__: f
    for f in (
        range_normalize, range_denormalize, bound_resolution, level_bounds, quantize_toward_zero, quantize_away_escape, dequantize, bag_histogram, code_histogram, entropy_bits, run_length, bit_width, shannon_code_bits,
        two_level_fix, quality_report, quality_by_group, lag1_autocorrelation, interpolation, block_regression, block_quadratic, coefficient_quantize, best_predictor_per_block, ridge_fit_k2, filtered_refit_k2, sampled_fit_k2,
        standardized_fit, mean_bin, quantization_intervals, range_prefilter, byte_truncation, huffman_bytes,
    )
}

SQL = {
    "range_normalize": f"with {NORM} select i, {R('x')} as x from s",
    "range_denormalize": f"select event_id as i, {R('value')} as x from events",
    "bound_resolution": """with a as (select min(value) as lo, max(value) as hi, count(*) as n from events) select round(2e-2, 9) as e_unit_rel, round(1e0 / (hi - lo), 9) as e_unit_abs, 0.5e0 as e_abs, round(1e-3 * (hi - lo), 9) as e_rel,
        round((hi - lo) * pow(10e0, (60 + 10 * log10(1 - 2e0 / 3 * 0.99e0)) / -20), 9) as e_psnr, round(sqrt(3e0 / n) * 10, 9) as e_norm, round(least(0.5e0, 1e-3 * (hi - lo)), 9) as e_abs_and_rel, round(greatest(0.5e0, 1e-3 * (hi - lo)), 9) as e_abs_or_rel from a""",
    "level_bounds": f"select range as level, round({BOUND!r}e0 * pow(0.95e0, range), 9) as e from range(16)",
    "quantize_toward_zero": f"with {_CODES} select i, code from c",
    "quantize_away_escape": f"with {_AWAY} select i, cast(code as bigint) as code, {R('case when code = 0 then x else v end')} as y from g",
    "dequantize": f"with {NORM}, c as (select i, {CODE.format(d='(x - 0.25e0)', e=f'{BOUND!r}e0')} as code from s) select i, {R(CLAMP.format(x=f'0.25e0 + 2 * {BOUND!r}e0 * code'))} as y from c",
    "bag_histogram": f"select {CODE.format(d='l_extendedprice', e='500e0')} as code, count(*) as n from lineitem group by 1",
    "code_histogram": f"with {_CODES} select code, count(*) as n from c group by code",
    "entropy_bits": f"with {_CODES}, h as (select count(*) as n from c group by code), t as (select sum(n) as t from h) select cast(max(t) as bigint) as n, count(*) as symbols, {R('-sum(n / t * log2(n / t))')} as bits from h, t",
    "run_length": f"""with {NORM}, c as (select i, {CODE.format(d="x", e="0.2e0")} as code from s), g as (select *, i - row_number() over (partition by code order by i) as island from c)
        select min(i) as begin, code, count(*) as length from g group by code, island""",
    "bit_width": f"with {_AWAY} select cast(length(bin(max(code))) as integer) as bits from g",
    "shannon_code_bits": f"with {_CODES}, h as (select code, count(*) as n from c group by code), t as (select sum(n) as t from h) select code, n, cast(greatest(1, ceil(log2(t / n))) as integer) as bits from h, t",
    "two_level_fix": f"with {_TWO} select i, level, code, {R('y')} as y from f",
    "quality_report": f"with {_TWO}, h as (select count(*) as m from f where code is not null group by code), b as (select -sum(m / t * log2(m / t)) as bits from h, (select sum(m) as t from h)) select {REPORT}, {R('(select bits from b)')} as bits from f",
    "quality_by_group": f"with v as (select event_type, value as x, 1000 * {CLAMP.format(x='1e-2 * ' + CODE.format(d='(value / 1000)', e='5e-3'))} as y from events) select event_type, {REPORT} from v group by event_type",
    "lag1_autocorrelation": f"with {SIGNAL}, m as (select avg(x) as m from s), d as (select i, x - m as d from s, m), e as (select d, lead(d) over (order by i) as n from d) select {R('avg(d * n) / avg(d * d)')} as autocorrelation from e",
    "interpolation": f"with {NORM}, n as (select i, lag(x, 3) over w as a, lag(x) over w as b, lead(x) over w as c, lead(x, 3) over w as d from s window w as (order by i)) select i, {', '.join(f'{R(v)} as p_{k}' for k, v in _INTERP.items())} from n where i % 2 = 1 and a is not null and d is not null",
    "block_regression": f"with {NORM} select i // {BLOCK} as block, {R(f'regr_slope(x, i % {BLOCK})')} as slope, {R(f'regr_intercept(x, i % {BLOCK})')} as intercept, count(*) as n from s group by 1",
    "block_quadratic": f"""with {NORM}, t as (select i // {BLOCK} as block, (i % {BLOCK}) * (2e0 / {BLOCK - 1}) - 1 as t, x from s), m as (select block, regr_slope(x, t) as c1, regr_slope(x, t * t) as c2, regr_intercept(x, t * t) as c0, count(*) as n from t group by block)
        select block, {R("c0")} as c0, {R("c1")} as c1, {R("c2")} as c2 from m where n = {BLOCK}""",
    "coefficient_quantize": f"""with {NORM}, m as (select i // {BLOCK} as block, regr_slope(x, i % {BLOCK}) as a, regr_intercept(x, i % {BLOCK}) as b from s group by 1), c as (select block, {CODE.format(d="a", e="2e-3")} as p, {CODE.format(d="b", e="2e-3")} as q from m)
        select block, p as slope_code, {R("4e-3 * p")} as slope, q as intercept_code, {R("4e-3 * q")} as intercept from c""",
    "best_predictor_per_block": f"""with {NORM}, o as (select i, i // {BLOCK} as block, i % {BLOCK} as p, x, coalesce(lag(x) over (order by i), 0) as a, coalesce(lag(x, 2) over (order by i), 0) as b from s),
        m as (select block, regr_slope(x, p) as u, regr_intercept(x, p) as v from o group by block), e as (select o.block, abs(x - a) as e1, abs(x - (2 * a - b)) as e2, abs(x) as e3, abs(x - (v + u * p)) as e4 from o join m using (block) where p in (0, {BLOCK - 1})),
        g as (select block, unnest(['lorenzo1', 'lorenzo2', 'none', 'regression']) as predictor, unnest([sum(e1), sum(e2), sum(e3), sum(e4)]) as err from e group by block)
        select block, arg_min(predictor, (err, predictor)) as predictor, {R("min(err)")} as err from g group by block""",
    "ridge_fit_k2": f"with {_PAIRS}, w as ({_solve_sql('q')}) select block, n, {R('w0')} as w0, {R('w1')} as w1 from w",
    "filtered_refit_k2": f"""with {_PAIRS}, w as ({_solve_sql("q")}), k as (select q.* from q join w using (block) where abs(w0 * a + w1 * b - x) <= {BOUND!r}e0 * 9), v as ({_solve_sql("k")})
        select w.block, coalesce(v.n, 0) as n, {R("coalesce(v.w0, 0.5e0)")} as w0, {R("coalesce(v.w1, 0.5e0)")} as w1 from w left join v using (block)""",
    "sampled_fit_k2": f"with {_PAIRS}, k as (select * from q where i % {BLOCK} // 2 % 4 = 0), w as ({_solve_sql('k')}) select block, n, {R('w0')} as w0, {R('w1')} as w1 from w",
    "standardized_fit": f"""with {_PAIRS}, {_zfit_sql("f", "q", 8)}, k as (select q.* from q join f using (block) where abs(w0 * a + w1 * b + w2 * i + w3 - x) <= {3 * BOUND!r}e0), {_zfit_sql("h", "k", 8)}
        select block, coalesce(n, 0) as n, {R("coalesce(w0, 0.5e0)")} as w0, {R("coalesce(w1, 0.5e0)")} as w1, {R("coalesce(w2, 0)")} as w2, {R("coalesce(w3, 0)")} as w3 from (select distinct block from q) left join h using (block)""",
    "mean_bin": f"""with {NORM}, m as (select avg(x) as m from s), b as (select cast(case when x - m > 0 then floor((x - m) / 2e-2) else ceil((x - m) / 2e-2) - 1 end as bigint) as bin from s, m),
        h as (select bin, count(*) as n from b group by bin), p as (select bin, sum(n) as n from (select bin, n from h union all select bin - 1, n from h) group by bin)
        select bin, cast(n as bigint) as n from p order by n desc, bin limit 1""",
    "quantization_intervals": f"""with {NORM}, o as (select x, coalesce(lag(x) over (order by i), 0) as p from s), k as (select least(cast(floor((abs(p - x) / 1e-3 + 1) / 2) as bigint), 8191) as k from o), h as (select k, count(*) as n from k group by k),
        c as (select k, sum(n) over (order by k) as s, sum(n) over () as t from h), f as (select coalesce(min(k) filter (s > floor(t * 0.999e0)), 8191) as k from c) select greatest(32, cast(2 * pow(2, ceil(log2(2 * (k + 1)))) as bigint)) as intervals from f""",
    "byte_truncation": f"""with {SIGNAL}, f as (select i, x, x::float::double as v from s), p as (select *, case when v = 0 then 0e0 else pow(2e0, floor(log2(abs(v))) - 7) end as unit from f)
        select i, {R("x")} as x, {R("case when v = 0 then 0e0 else trunc(v / unit) * unit end")} as y from p""",
    "range_prefilter": "select event_id as i, case when value between 10 and 100 then value else -1 end as x from events",
}

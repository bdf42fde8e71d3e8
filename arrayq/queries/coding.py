"""Queries over transforms and codes: wavelet, entropy coder, byte forms, value levels, and predictors at the edges of an array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as Y
from ..operators import ans, levels, wavelet
from ..operators import predict as P
from .common import NORM, PLANE, R, normalized, plane, rounded, table
from .signal import quantize_toward_zero

#: Levels of the wavelet, neighbours of a cell.
LEVELS, CROSS = 3, ((-1, 0), (1, 0), (0, -1), (0, 1))


def _size(rows: DataFrame) -> int:
    return wavelet.padded_size((rows.agg(F.max("i")).first()[0] or 0) + 1)


def wavelet_forward(spark, sf) -> DataFrame:
    s = normalized(spark, sf)
    return rounded(wavelet.forward(s, max(_size(s), 1 << LEVELS), LEVELS), "x")


def wavelet_round_trip(spark, sf) -> DataFrame:
    s = normalized(spark, sf)
    size = max(_size(s), 1 << LEVELS)
    return rounded(wavelet.backward(wavelet.forward(s, size, LEVELS), size, LEVELS).join(s.select("i"), "i", "left_semi"), "x")


def range_coded_bytes(spark, sf) -> DataFrame:
    rows, _ = ans.packed(quantize_toward_zero(spark, sf))
    return rows.select("part", "n", F.length("content").alias("bytes"))


def int_bytes(spark, sf) -> DataFrame:
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    return keys.select("k", *(F.hex(Y.to_bytes(F.col("k"), n)).alias(f"b{n}") for n in (2, 4, 8)), Y.from_bytes(Y.to_bytes(F.col("k"), 2), 2).alias("low"), Y.from_bytes(Y.to_bytes(-F.col("k"), 8), 8).alias("negative"))


def edge_mean_2d(spark, sf) -> DataFrame:
    return rounded(P.mean_of_present(plane(spark, sf), 2, CROSS).select("i0", "i1", "pred"), "pred")


def quadric_2d(spark, sf) -> DataFrame:
    q = P.quadratic(plane(spark, sf), (10, 10)).where("n = 100")
    return rounded(q.select("b0", "b1", *(F.col("w")[k].alias(f"w{k}") for k in range(6))), *(f"w{k}" for k in range(6)))


def value_levels(spark, sf) -> DataFrame:
    """Levels of a signal that has some: amounts of goods, with a little noise."""
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") + (F.col("l_linenumber") - 4) / 100).alias("x"))
    return rounded(levels.fitted(rows, most=60), "start", "step")


def _wavelet_sql() -> str:
    low, high = ([f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in f] for f in (wavelet.LOW, wavelet.HIGH))
    pick = lambda f: f"case when i % 2 = 0 then case when o = 0 then {f[0]} else {f[2]} end else case when o = 0 then {f[1]} else {f[3]} end end"
    out = [f"with {NORM}, z as (select greatest({1 << LEVELS}, cast(pow(2, ceil(log2(max(i) + 1))) as bigint)) as n from s), o as (select unnest([0, 1]) as o), a0 as (select i, x from s)"]
    for k in range(1, LEVELS + 1):
        half = f"(n // {1 << k})"
        out.append(f"c{k} as (select (i // 2 - o + {half}) % {half} as k, sum({pick(low)} * x) as a, sum({pick(high)} * x) as d from a{k - 1}, z, o group by 1), a{k} as (select k as i, a as x from c{k})")
    parts = [f"select k + n // {1 << k} as i, {R('d')} as x from c{k}, z" for k in range(1, LEVELS + 1)]
    return ", ".join(out) + " " + " union all ".join([f"select i, {R('x')} as x from a{LEVELS}", *parts])


QUERIES = {f.__name__: f for f in (wavelet_forward, wavelet_round_trip, range_coded_bytes, int_bytes, edge_mean_2d, quadric_2d, value_levels)}

SQL = {
    # on a full block the places t, u and their products are not correlated, but for the squares with the mean
    "quadric_2d": f"""with {PLANE}, p as (select i0 // 10 as b0, i1 // 10 as b1, (i0 % 10) * (2e0 / 9) - 1 as t, (i1 % 10) * (2e0 / 9) - 1 as u, x from a),
        m as (select b0, b1, count(*) as n, avg(x) as m, avg(t * t) as q, regr_slope(x, t) as w1, regr_slope(x, u) as w2, regr_slope(x, t * t) as w3, regr_slope(x, t * u) as w4, regr_slope(x, u * u) as w5 from p group by b0, b1)
        select b0, b1, {R("m - (w3 + w5) * q")} as w0, {", ".join(f"{R(f'w{k}')} as w{k}" for k in range(1, 6))} from m where n = 100""",
    "wavelet_forward": _wavelet_sql(),
    "wavelet_round_trip": f"with {NORM} select i, {R('x')} as x from s",
    "int_bytes": """select distinct o_orderkey as k, right(format('{:016X}', o_orderkey), 4) as b2, right(format('{:016X}', o_orderkey), 8) as b4, format('{:016X}', o_orderkey) as b8,
        o_orderkey % 65536 - case when o_orderkey % 65536 >= 32768 then 65536 else 0 end as low, -o_orderkey as negative from orders""",
    "edge_mean_2d": f"""with {PLANE}, o as (select unnest([-1, 1, 0, 0]) as u, unnest([0, 0, -1, 1]) as v)
        select a.i0, a.i1, {R("coalesce(avg(b.x), 0)")} as pred from a, o left join a b on b.i0 = a.i0 + u and b.i1 = a.i1 + v group by a.i0, a.i1""",
}

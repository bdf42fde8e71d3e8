"""Queries over whole streams: arrays of one to four dimensions compressed to bytes and read back, and choices among predictors."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import entropy as E
from ..operators import metrics as M
from ..operators import predict as P
from ..plans import codec, stencils, stream
from ..runtime import saved
from ..sources import raw
from .common import BOUND, NORM, PLANE, SPACE, R, normalized, plane, rounded, space, table
from .signal import quantize_away_escape

#: Axes behind the first, method and block sizes of the stream queries; every one takes the plan that halves all axes to the end.
STREAMS = {1: ((), "cubic", (4096,)), 2: ((100,), "robust", (64, 64)), 3: ((10, 10), "ridge", (16, 10, 10)), 4: ((5, 5, 4), "fix", (16, 5, 5, 4))}
#: Sides of the blocks that predictors are chosen for; frames in a batch, batches in a turn.
SIDE, FRAMES, TURN = 5, 4, 5


def _array(spark, sf, ndim: int) -> tuple[DataFrame, tuple[int, ...]]:
    rest = STREAMS[ndim][0]
    cells = A.fold(normalized(spark, sf), (0, *rest)).select(*A.axes(ndim), "x")
    return cells, ((cells.agg(F.max("i0")).first()[0] or 0) + 1, *rest)


def _stream(spark, sf, ndim: int) -> tuple[DataFrame, stream.Header, DataFrame]:
    cells, shape = _array(spark, sf, ndim)
    _, method, sizes = STREAMS[ndim]
    header, parts = stream.encoded(cells, shape, stencils.axis_plan(shape), BOUND, method, sizes)
    return cells, header, saved(parts)


def _levels(ndim: int):
    def run(spark, sf) -> DataFrame:
        """Cells of each level that come back from the bytes, and how many of them within the level's bound."""
        cells, header, parts = _stream(spark, sf, ndim)
        back = stream.decoded(header, parts).join(cells, A.axes(ndim)).withColumn("level", stencils.level(header.plan()))
        bound = BOUND * F.pow(F.lit(header.ratio), F.col("level")) * (1 + 1e-9)
        within = F.when(F.col("level") == len(header.plan()), F.col("x") == F.col("y")).otherwise(F.abs(F.col("x") - F.col("y")) <= bound)
        return back.groupBy("level").agg(F.count("*").alias("n"), F.count(F.when(within, 1)).alias("within"))

    run.__name__ = f"stream_levels_{ndim}d"
    return run


def stream_bytes(spark, sf) -> DataFrame:
    """What a compressed plane consists of."""
    _, header, parts = _stream(spark, sf, 2)
    return stream.size(header, parts)


def stream_ratio(spark, sf) -> DataFrame:
    """Bytes of the values as 32-bit numbers over the bytes of their stream, for one to four axes."""
    out = None
    with ThreadPoolExecutor(len(STREAMS)) as pool:  # a coarse step has few cells, so the other arrays' steps run beside it
        streams = list(pool.map(lambda ndim: _stream(spark, sf, ndim), STREAMS))
    for ndim, (_, header, parts) in zip(STREAMS, streams, strict=True):
        one = stream.size(header, parts).agg(F.sum(F.when(F.col("kind").isin("code", "stored"), F.col("n"))).alias("cells"), F.sum("bytes").alias("after"))
        one = one.select(F.lit(ndim).alias("axes"), "cells", M.ratio(4 * F.col("cells"), F.col("after")).alias("cr"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "cr")


def threshold_sweep(spark, sf) -> DataFrame:
    cells, shape = _array(spark, sf, 2)
    return codec.threshold_sweep(cells, shape, stencils.axis_plan(shape, 2), BOUND, (2.0, 4.0, 9.0), (64, 64))


def _selection(ndim: int):
    def run(spark, sf) -> DataFrame:
        cells = (plane if ndim == 2 else space)(spark, sf)
        return rounded(P.selected(cells, (SIDE,) * ndim, BOUND), "err")

    run.__name__ = f"block_selection_{ndim}d"
    return run


def block_selection_mean_2d(spark, sf) -> DataFrame:
    """As block_selection_2d, but the mean of all values may also be taken."""
    cells = plane(spark, sf)
    return rounded(P.selected(cells, (SIDE, SIDE), BOUND, A.scalar_of(cells, F.avg("x"))), "err")


def frame_methods(spark, sf) -> DataFrame:
    return rounded(P.frame_methods(plane(spark, sf), "i0", "i1", BOUND, FRAMES, TURN, 10), "bits")


def packed_ints(spark, sf) -> DataFrame:
    """Codes of nine bits packed and unpacked again."""
    codes = quantize_away_escape(spark, sf).select("i", "code")
    return E.bits_unpacked(saved(E.bits_packed(codes, 9, 4096)), 9, 4096)


def packed_ints_bytes(spark, sf) -> DataFrame:
    codes = quantize_away_escape(spark, sf).select("i", "code")
    return E.bits_packed(codes, 9, 4096).select("part", "n", F.length("content").cast("long").alias("bytes"))


def retagged_files(spark, sf) -> DataFrame:
    names = table(spark, sf, "part").select(F.explode(F.array(F.format_string("p%d.qoz", "p_partkey"), F.when(F.col("p_partkey") % 3 == 0, F.format_string("p%d.qoz2", "p_partkey")))).alias("name")).where("name is not null")
    return raw.retagged(names, "qoz", "qoz2")


def missing_blocks(spark, sf) -> DataFrame:
    wanted = raw.block_files(spark, "array", [4, 3, 2])
    return raw.missing(wanted, wanted.where(F.col("name").rlike("_[01]$") & ~F.col("name").startswith("array_2_")))


def bound_share(spark, sf) -> DataFrame:
    """Loss of predicting odd cells by the mean of their neighbours along each axis, in bins."""
    rows = space(spark, sf)
    out = None
    for k in range(3):
        one = M.predictability(rows, f"i{k}", [f"i{j}" for j in range(3) if j != k])
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("axis", M.bound_share(F.col("mse"), BOUND).alias("share")), "share")


def _levels_sql(ndim: int) -> str:
    """A cell belongs to the axis on which its place has fewest trailing zero bits, the last of equal ones; steps go by stride, the last axis first."""
    rest = STREAMS[ndim][0]
    coords, step = [], 1
    for k in range(ndim - 1, 0, -1):
        coords.insert(0, f"i // {step} % {rest[k - 1]} as i{k}")
        step *= rest[k - 1]
    coords.insert(0, f"i // {step} as i0")
    bits = [f"(select cast(ceil(log2(max(i // {step}) + 1)) as bigint) from s)" if k == 0 else str((rest[k - 1] - 1).bit_length()) for k in range(ndim)]
    zeros = ", ".join(f"case when i{k} = 0 then 99 else bit_count((i{k} & -i{k}) - 1) end as z{k}" for k in range(ndim))
    least = "least(" + ", ".join(f"z{k}" for k in range(ndim)) + ")" if ndim > 1 else "z0"
    which = "case " + " ".join(f"when z{k} = z then {k}" for k in range(ndim - 1, -1, -1)) + " end"
    before = " + ".join(f"least({b}, z + case when {j} > axis then 1 else 0 end)" for j, b in enumerate(bits))
    return f"""with {NORM}, a as (select {", ".join(coords)} from s), z as (select {zeros} from a), m as (select *, {least} as z from z), k as (select *, {which} as axis from m),
        l as (select cast(case when z = 99 then {" + ".join(bits)} else {before} end as integer) as level from k) select level, count(*) as n, count(*) as within from l group by level"""


def _selection_sql(ndim: int, mean: bool = False) -> str:
    side, n = SIDE, ndim
    one, two = P.lorenzo_offsets(n, 1), P.lorenzo_offsets(n, 2)
    values = ", ".join(f"({', '.join(map(str, o))}, {one.get(o, 0)}e0, {w}e0)" for o, w in two.items())
    ax = [f"i{k}" for k in range(n)]
    diagonal = " and ".join(f"(i{k} % {side} = i0 % {side} or i{k} % {side} = {side - 1} - i0 % {side})" for k in range(1, n))
    keys = ", ".join(f"i{k} // {side} as b{k}" for k in range(n))
    bs = ", ".join(f"b{k}" for k in range(n))
    planes = ", ".join(f"regr_slope(x, i{k} % {side}) as c{k}" for k in range(n))
    plane_ = "avg(x) - " + " - ".join(f"regr_slope(x, i{k} % {side}) * {(side - 1) / 2}e0" for k in range(n))
    near = lambda k: (f"least(abs(x - (select avg(x) from a)), abs(x - p{k}) + {BOUND * P.LORENZO_NOISE[k][n]!r}e0)" if mean else f"abs(x - p{k}) + {BOUND * P.LORENZO_NOISE[k][n]!r}e0")
    fitted = "m.q + " + " + ".join(f"m.c{k} * (l.i{k} % {side})" for k in range(n))
    return f"""with {PLANE if n == 2 else SPACE}, o as (select * from (values {values}) o({", ".join(f"o{k}" for k in range(n))}, w1, w2)), d as (select * from a where {diagonal}),
        l as (select {", ".join(f"d.{c}" for c in ax)}, any_value(d.x) as x, sum(w1 * coalesce(v.x, 0)) as p1, sum(w2 * coalesce(v.x, 0)) as p2 from d cross join o left join a v on {" and ".join(f"v.i{k} = d.i{k} + o.o{k}" for k in range(n))} group by {", ".join(f"d.{c}" for c in ax)}),
        m as (select {keys}, {planes}, {plane_} as q from a group by {", ".join(f"i{k} // {side}" for k in range(n))} having count(*) = {side**n}),
        e as (select {", ".join(f"m.b{k}" for k in range(n))}, sum({near(1)}) as e1, sum({near(2)}) as e2, sum(abs(x - ({fitted}))) as e3 from l join m on {" and ".join(f"l.i{k} // {side} = m.b{k}" for k in range(n))} group by {", ".join(f"m.b{k}" for k in range(n))}),
        g as (select {bs}, unnest(['lorenzo1', 'lorenzo2', 'regression']) as predictor, unnest([e1, e2, e3]) as err from e)
        select {bs}, arg_min(predictor, (err, predictor)) as predictor, {R("min(err)")} as err from g group by {bs}"""


_SHARE = " union all ".join(f"select 'i{k}' as axis, i{k} as p, (lag(x) over w + lead(x) over w) / 2 - x as e from a window w as (partition by {', '.join(f'i{j}' for j in range(3) if j != k)} order by i{k})" for k in range(3))
_BITS = "count(*) as t, sum(n) as n, sum(n) * log2(sum(n)) - sum(n * log2(n)) as bits"

QUERIES = {f.__name__: f for f in (*map(_levels, STREAMS), stream_bytes, stream_ratio, threshold_sweep, _selection(2), _selection(3), block_selection_mean_2d, frame_methods, packed_ints, packed_ints_bytes, retagged_files, missing_blocks, bound_share)}

SQL = {
    **{f"stream_levels_{n}d": _levels_sql(n) for n in STREAMS},
    "block_selection_2d": _selection_sql(2),
    "block_selection_3d": _selection_sql(3),
    "block_selection_mean_2d": _selection_sql(2, True),
    "frame_methods": f"""with {PLANE}, f as (select *, i0 // {FRAMES} as batch, coalesce(lag(x) over (partition by i1 order by i0), 0) as p, case when i0 % {FRAMES} = 0 then 0e0 else first_value(x) over (partition by i1, i0 // {FRAMES} order by i0) end as q from a),
        m as (select i0, batch // {TURN} as turn, unnest(['previous', 'first', 'none']) as method, unnest([x - p, x - q, x]) as d from f),
        c as (select turn, i0, method, cast(case when d >= 0 then ceil((d - {BOUND!r}e0) / {2 * BOUND!r}e0) else floor((d + {BOUND!r}e0) / {2 * BOUND!r}e0) end as bigint) as code from m),
        t as (select turn, method, {_BITS} from (select turn, method, code, count(*) as n from c where i0 - turn * {FRAMES * TURN} < 10 group by all) group by turn, method),
        w as (select turn, arg_min(method, (bits, method)) as method from t group by turn), h as (select turn, method, {_BITS} from (select turn, method, code, count(*) as n from c join w using (turn, method) group by all) group by turn, method)
        select turn, method, cast(n as bigint) as n, {R("bits")} as bits from h""",
    "packed_ints": """with h as (select event_id as i, value as x, (cast(floor(abs(value) / 0.5e0) as bigint) + 1) // 2 * (case when value < 0 then -1 else 1 end) as q from events)
        select i, cast(case when floor(abs(x) / 0.5e0) + 1 < 512 and abs(q - x) <= 0.5e0 then q + 256 else 0 end as bigint) as code from h""",
    "packed_ints_bytes": "select event_id // 4096 as part, count(*) as n, cast(ceil(count(*) * 9 / 8) as bigint) as bytes from events group by 1",
    "retagged_files": "select 'p' || p_partkey || '.qoz' as name, 'p' || p_partkey || '.qoz2' as renamed, p_partkey % 3 = 0 as taken from part",
    "missing_blocks": "select 'array_' || a.range || '_' || b.range || '_' || c.range as name from range(4) a, range(3) b, range(2) c where a.range = 2",
    "bound_share": f"with {SPACE}, d as ({_SHARE}) select axis, {R(f'sqrt(avg(e * e)) / {2 * BOUND!r}e0')} as share from d where p % 2 = 1 group by axis",
}

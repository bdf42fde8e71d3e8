"""Queries over arrays of several dimensions, level plans, images, sweeps and catalogues."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bounds as B
from ..functions import quantize as Q
from ..operators import arrays as A
from ..operators import imaging as G
from ..operators import metrics as M
from ..operators import predict as P
from ..operators import sweep as S
from ..plans import codec, stencils
from ..sources import raw
from .common import BOUND, CUBE, PLANE, REPORT, SPACE, WIDTH, R, normalized, plane, rounded, signal, space, table


def fold3d(spark, sf) -> DataFrame:
    return rounded(space(spark, sf), "x")


def unfold(spark, sf) -> DataFrame:
    return rounded(A.unfold(space(spark, sf), (0, *CUBE)).select("i", "x"), "x")


def explode_vectors(spark, sf) -> DataFrame:
    return rounded(A.explode_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding"), "x")


def transpose(spark, sf) -> DataFrame:
    return rounded(A.transpose(space(spark, sf), (2, 0, 1)), "x")


def rotate(spark, sf) -> DataFrame:
    return rounded(A.rotate(space(spark, sf), CUBE[1]), "x")


def downsample(spark, sf) -> DataFrame:
    return rounded(A.downsample(plane(spark, sf), 2, 4), "x")


def upsample(spark, sf) -> DataFrame:
    return rounded(A.upsample(A.downsample(plane(spark, sf), 2, 4), 2, 2), "x")


def blockify(spark, sf) -> DataFrame:
    b = A.blocked(space(spark, sf), (4, 4, 4)).groupBy("b0", "b1", "b2").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("p0").alias("p0"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    return rounded(b, "total")


def halo_gather(spark, sf) -> DataFrame:
    h = A.with_halo(plane(spark, sf), (16, 16)).groupBy("b0", "b1").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("own"), F.sum("x").alias("total"))
    return rounded(h, "total")


def neighbour_gather(spark, sf) -> DataFrame:
    offsets = [(0, -1), (0, 1), (-1, 0), (1, 0)]
    return rounded(A.gathered(plane(spark, sf), 2, offsets), "x", *(f"n{k}" for k in range(4)))


def tile_merge(spark, sf) -> DataFrame:
    """The whole signal cut into overlapping tiles, of which the last one wins."""
    s = signal(spark, sf)
    size = (s.agg(F.max("i")).first()[0] or 0) + 1
    return rounded(A.merge_tiles(A.tiled(s, size, 300).withColumn("x", F.col("x") + F.col("tile")), ["i"]), "x")


def _lorenzo(ndim: int, layers: int):
    def run(spark, sf) -> DataFrame:
        if ndim == 1:
            rows = normalized(spark, sf).withColumnRenamed("i", "i0")
        elif ndim == 4:
            rows = A.fold(normalized(spark, sf), (0, 5, 5, 4)).select("i0", "i1", "i2", "i3", "x")
        else:
            rows = plane(spark, sf) if ndim == 2 else space(spark, sf)
        return rounded(P.lorenzo(rows, ndim, layers).drop("x"), "pred")

    run.__name__ = f"lorenzo{layers}_{ndim}d"
    return run


def _lorenzo_sql(ndim: int, layers: int) -> str:
    w = {1: (1, -1), 2: (1, -2, 1)}[layers]
    cells = {1: f"{PLANE.partition(', a as')[0]}, a as (select i as i0, x from s)", 2: PLANE, 3: SPACE, 4: f"{PLANE.partition(', a as')[0]}, a as (select i // 100 as i0, i // 20 % 5 as i1, i // 4 % 5 as i2, i % 4 as i3, x from s)"}[ndim]
    terms, joins = [], []
    for k, at in enumerate(product(range(layers + 1), repeat=ndim)):
        if any(at):
            c = -1
            for d in at:
                c *= w[d]
            terms.append(f"{c} * coalesce(t{k}.x, 0)")
            joins.append(f"left join a t{k} on " + " and ".join(f"t{k}.i{j} = a.i{j} - {d}" for j, d in enumerate(at)))
    return f"with {cells} select {', '.join(f'a.i{j}' for j in range(ndim))}, {R(' + '.join(terms))} as pred from a {' '.join(joins)}"


def block_regression_3d(spark, sf) -> DataFrame:
    return rounded(P.block_regression(space(spark, sf), (5, 5, 5)), "c0", "c1", "c2", "intercept")


def previous_frame(spark, sf) -> DataFrame:
    rows = P.previous_frame(plane(spark, sf), ["i1"], "i0")
    return M.histogram(M.codes_of(rows, BOUND))


def predictability_by_axis(spark, sf) -> DataFrame:
    s = space(spark, sf)
    parts = [M.predictability(s, f"i{k}", [f"i{j}" for j in range(3) if j != k]) for k in range(3)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "mse")


def frame_stats(spark, sf) -> DataFrame:
    pixels = A.fold(signal(spark, sf), (0, *CUBE)).select("i0", F.floor(F.col("x") / 10).alias("x"))
    r = M.frame_stats(pixels, ["i0"])
    return rounded(r, *r.columns[1:])


def group_ranges(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count("*").alias("n"))


def sampled_blocks(spark, sf) -> DataFrame:
    """The corner parts of each block, which a sample of an array is made of."""
    b = A.blocked(plane(spark, sf), (20, 20)).where("(p0 < 3 or p0 >= 17) and (p1 < 3 or p1 >= 17)")
    return rounded(b.groupBy("b0", "b1").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "mean")


def effective_rank(spark, sf) -> DataFrame:
    return M.effective_rank(table(spark, sf, "embeddings"), "embedding")


def group_moments(spark, sf) -> DataFrame:
    v = A.explode_vectors(table(spark, sf, "embeddings"), "label", "embedding").groupBy("i0", "i1").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).where("std > 0")
    return rounded(v, "mean", "std")


# level plans

_BITS = "aggregate({}, 0L, (a, v) -> a + shiftleft(1L, v))"


def stencil_catalog(spark, sf) -> DataFrame:
    return stencils.catalog_table(spark).select("ndim", F.expr(_BITS.format("known")).alias("known"), F.expr(_BITS.format("targets")).alias("targets"), "n_targets")


def stencil_neighbours(spark, sf) -> DataFrame:
    return stencils.catalog_table(spark).select("ndim", F.expr(_BITS.format("known")).alias("known"), F.expr(_BITS.format("targets")).alias("targets"), "n_neighbours")


def stencil_eligibility(spark, sf) -> DataFrame:
    ids = stencils.eligible(stencils.start(3), (5, 1, 3))
    return stencils.catalog_table(spark, [3]).where(F.col("id").isin(ids)).select(F.expr(_BITS.format("known")).alias("known"), F.expr(_BITS.format("targets")).alias("targets"))


_STENCILS = """d as (select unnest([1, 2, 3, 4]) as n), m as (select n, range as k from d, range(1, 65535, 2) where range < (1::bigint << (1 << n)) - 1),
    bad as (select distinct n, k from m, range(16) a(a), range(16) b(b) where (k >> a.a) & (k >> b.b) & 1 = 1 and a.a < b.b and (k >> xor(a.a, b.b)) & 1 = 0),
    sub as (select * from m anti join bad using (n, k)),
    c as (select distinct n, k, (select sum(1::bigint << xor(x.x, v.v)) from range(16) x(x) where (k >> x.x) & 1 = 1) as t from sub, range(16) v(v) where v.v < (1 << n) and (k >> v.v) & 1 = 0)"""


def level_assignment(spark, sf) -> DataFrame:
    cells = plane(spark, sf)
    plan = stencils.axis_plan((10**6, WIDTH), 4)
    return cells.select("i0", "i1", stencils.level(plan).alias("level"))


def pivots(spark, sf) -> DataFrame:
    cells = plane(spark, sf)
    plan = stencils.axis_plan((10**6, WIDTH), 6)
    return rounded(cells.where(stencils.level(plan) == len(plan)), "x")


def level_plan(spark, sf) -> DataFrame:
    """The plan for a 256 x 390 x 454 array, one row a step."""
    shape = (256, 390, 454)
    return stencils.plan_table(spark, stencils.axis_plan(shape), shape).select("step", F.concat_ws(" ", F.transform("shape", lambda x: x.cast("string"))).alias("shape"))


def _multilevel(method: str):
    def run(spark, sf) -> DataFrame:
        rows = A.explode_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
        r = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
        unit = rows.withColumn("x", 2 * (F.col("x") - r["lo"]) / (r["hi"] - r["lo"]) - 1)
        shape = (rows.agg(F.max("i0")).first()[0] + 1, 64)
        out = codec.compressed(unit, shape, stencils.axis_plan(shape, STEPS), BOUND, method, (128, 64))
        report = M.report(out)
        bits = M.entropy(M.histogram(out.where("code is not null"))).select("bits")
        out = report.withColumn("bits", bits.scalar())
        return rounded(out, *[c for c in out.columns if c != "n"])

    run.__name__ = f"multilevel_{method}"
    return run


STEPS = 6  # of the plan of multilevel_*


def _multilevel_sql() -> str:
    """The closed loop of the baseline over an embedding matrix, level by level; the last axis is halved first."""
    out = ["with e as (select vec_id as i0, unnest(range(len(embedding))) as i1, unnest(embedding)::double as v from embeddings), r as (select min(v) as lo, max(v) as hi from e), a as (select i0, i1, 2e0 * (v - lo) / (hi - lo) - 1 as x from e, r)"]
    # before step k the grid has strides 2 ** (k // 2) on axis 0 and 2 ** ((k + 1) // 2) on axis 1
    out.append(f"k{STEPS} as (select i0, i1, x, x as y, cast(null as bigint) as code from a where i0 % {2 ** (STEPS // 2)} = 0 and i1 % {2 ** ((STEPS + 1) // 2)} = 0)")
    for k in range(STEPS - 1, -1, -1):
        axis, s0, s1 = (1 if k % 2 == 0 else 0), 2 ** (k // 2), 2 ** ((k + 1) // 2)
        step = (s0, s1)[axis]
        there = f"i0 % {s0} = 0 and i1 % {s1} = 0 and i{axis} // {step} % 2 = 1"
        near = lambda o: f"n.i{axis} = t.i{axis} {o} {step} and n.i{1 - axis} = t.i{1 - axis}"
        pred = "greatest(-1e0, least(1e0, 0.5e0 * coalesce(u.y, 0) + 0.5e0 * coalesce(w.y, 0)))"
        e = repr(BOUND * 0.95**k) + "e0"
        out.append(f"p{k} as (select t.i0, t.i1, t.x, {pred} as p from a t left join k{k + 1} u on {near('-').replace('n.', 'u.')} left join k{k + 1} w on {near('+').replace('n.', 'w.')} where {there.replace('i0', 't.i0').replace('i1', 't.i1')})")
        out.append(f"c{k} as (select *, cast(case when x - p >= 0 then ceil((x - p - {e}) / (2 * {e})) else floor((x - p + {e}) / (2 * {e})) end as bigint) as code from p{k})")
        out.append(f"k{k} as (select * from k{k + 1} union all select i0, i1, x, greatest(-1e0, least(1e0, p + 2 * {e} * code)), code from c{k})")
    out.append("h as (select count(*) as m from k0 where code is not null group by code), b as (select -sum(m / t * log2(m / t)) as bits from h, (select sum(m) as t from h))")
    return ", ".join(out) + f" select {REPORT}, {R('(select bits from b)')} as bits from k0"


def plan_search(spark, sf) -> DataFrame:
    """The stencil of least loss at every step, until one cell is left."""
    s = plane(spark, sf)
    shape = (s.agg(F.max("i0")).first()[0] + 1, WIDTH)
    _, found = codec.searched(s, shape, stencils.halvings(shape), BOUND, "robust", (100, 100))
    return spark.createDataFrame(found, "step int, stencil int, loss double")


# images


def bitfield_decode(spark, sf) -> DataFrame:
    raw_pixel = (F.col("event_id") * 7919 % 65536).cast("int")
    return table(spark, sf, "events").select("event_id", G.gain(raw_pixel).alias("gain"), G.intensity(raw_pixel).alias("intensity"))


def roi_slice(spark, sf) -> DataFrame:
    return rounded(G.region_of_interest(plane(spark, sf), (3, 50), (20, 30)), "x")


def _regions(spark, sf) -> DataFrame:
    """Frames of 12 rows in pairs, the second one's pixels as b beside the first one's as a; each pair has regions of 12 columns, of which every fourth is masked out."""
    cells = plane(spark, sf).select(F.expr("i0 div 24").alias("pair"), (F.col("i0") % 24).alias("i0"), "i1", "x")
    one = cells.where("i0 < 12").select("pair", "i0", "i1", F.expr("i1 div 12").alias("part"), F.col("x").alias("a"))
    two = cells.where("i0 >= 12").select("pair", (F.col("i0") - 12).alias("i0"), "i1", F.col("x").alias("b"))
    return one.join(two, ["pair", "i0", "i1"]).where("part % 4 <> 0 and (i0 + i1) % 7 <> 0").select("i0", "i1", (F.col("pair") * REGIONS + F.col("part")).alias("region"), "a", "b")


REGIONS = 16  # more than a pair of frames has
_REGIONS = f"{PLANE}, p as (select u.i0 % 24 as i0, u.i1, u.i0 // 24 * {REGIONS} + u.i1 // 12 as region, u.x as a, v.x as b from a u join a v on v.i0 = u.i0 + 12 and v.i1 = u.i1 where u.i0 % 24 < 12 and u.i1 // 12 % 4 <> 0 and (u.i0 % 24 + u.i1) % 7 <> 0)"
_CROSS = f"""{_REGIONS}, m as (select region, avg(a) as ma, avg(b) as mb from p group by region),
    k as (select u.region, u.i0 - v.i0 as d0, u.i1 - v.i1 as d1, sum(u.a * v.b) as cc, count(*) as overlap, sum(u.a) as l, sum(v.b) as r from p u join p v on u.region = v.region and abs(u.i0 - v.i0) <= 3 and abs(u.i1 - v.i1) <= 3 group by 1, 2, 3),
    x as (select k.*, case when abs(l * r) > 0 then cc * overlap / l / r else cc end as sym, cc / (overlap * ma * mb) as reg from k join m using (region))"""


def region_boxes(spark, sf) -> DataFrame:
    return G.region_boxes(_regions(spark, sf))


def cross_correlation(spark, sf) -> DataFrame:
    c = G.correlation(_regions(spark, sf), (3, 3))
    return rounded(c.select("region", "d0", "d1", "overlap", "cc", G.symmetric(c).alias("sym"), G.regular(c).alias("reg")), "cc", "sym", "reg", digits=5)


def subpixel_peak(spark, sf) -> DataFrame:
    p = G.peak(G.correlation(_regions(spark, sf), (3, 3)), ["region"], "cc")
    return rounded(p, "shift0", "shift1", "contrast", "fwhm0", "fwhm1", digits=5)


def _frames(spark, sf) -> DataFrame:
    """(frame, i0, i1, region, x) of every cell: frames of 12 rows, regions 1, 2, .. of 12 columns; bad pixels lie in region 0."""
    good = F.expr("(i0 % 12 + i1) % 7 <> 0")
    return plane(spark, sf).select(F.expr("i0 div 12").alias("frame"), (F.col("i0") % 12).alias("i0"), "i1", F.when(good, F.expr("i1 div 12") + 1).otherwise(0).alias("region"), "x")


def _frame_pairs(spark, sf) -> DataFrame:
    """Each frame's pixels as a with those of the next frame as b, outside region 0."""
    cells = _frames(spark, sf).where("region <> 0")
    following = cells.select((F.col("frame") - 1).alias("frame"), "i0", "i1", F.col("x").alias("b"))
    return cells.withColumnRenamed("x", "a").join(following, ["frame", "i0", "i1"])


_MASKED = f"{PLANE}, f as (select i0 // 12 as frame, i0 % 12 as i0, i1, case when (i0 % 12 + i1) % 7 <> 0 then i1 // 12 + 1 else 0 end as region, x from a)"
_LAGS = f"""{_MASKED}, p as (select u.frame, u.i0, u.i1, u.region, u.x as a, v.x as b from f u join f v on v.frame = u.frame + 1 and v.i0 = u.i0 and v.i1 = u.i1 where u.region <> 0), m as (select frame, region, avg(a) as ma, avg(b) as mb from p group by frame, region),
    k as (select u.frame, u.region, u.i0 - v.i0 as d0, u.i1 - v.i1 as d1, sum(u.a * v.b) as cc, count(*) as overlap, sum(u.a) as l, sum(v.b) as r from p u join p v on u.frame = v.frame and u.region = v.region and abs(u.i0 - v.i0) <= 3 and abs(u.i1 - v.i1) <= 3 group by 1, 2, 3, 4)"""


def frame_region_boxes(spark, sf) -> DataFrame:
    return G.region_boxes(_frames(spark, sf), by=["frame"])


def frame_cross_correlation(spark, sf) -> DataFrame:
    c = G.correlation(_frame_pairs(spark, sf), (3, 3), ["frame", "region"])
    return rounded(c.select("frame", "region", "d0", "d1", "overlap", "cc", G.symmetric(c).alias("sym"), G.regular(c).alias("reg")), "cc", "sym", "reg", digits=5)


def frame_subpixel_peak(spark, sf) -> DataFrame:
    by = ["frame", "region"]
    p = G.peak(G.correlation(_frame_pairs(spark, sf), (3, 3), by), by, "cc")
    return rounded(p, "shift0", "shift1", "contrast", "fwhm0", "fwhm1", digits=5)


# sweeps


def _sweep(spark, sf) -> DataFrame:
    """Ratios of an order-0 coder for blocks of a signal at several bounds."""
    s = normalized(spark, sf).withColumn("block", F.expr("i div 1000"))
    s = s.withColumn("rel_eb", F.explode(F.array(*map(F.lit, (0.1, 0.05, 0.02, 0.01)))))
    code = Q.toward_zero(F.col("x"), 2 * F.col("rel_eb"))
    bits = M.entropy(M.histogram(s.withColumn("code", code), by=["block", "rel_eb"]), ["block", "rel_eb"]).select("block", "rel_eb", (32 / F.greatest("bits", F.lit(0.01))).alias("cr"))
    d = F.col("x") - Q.dequantize(F.lit(0.0), code, 2 * F.col("rel_eb"))
    mse = s.groupBy("block", "rel_eb").agg(F.avg(d * d).alias("mse"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return bits.join(mse, ["block", "rel_eb"])


_CODE = "cast(case when x >= 0 then ceil((x - 2 * rel_eb) / (4 * rel_eb)) else floor((x + 2 * rel_eb) / (4 * rel_eb)) end as bigint)"
_SWEEP = f"""{PLANE.partition(", a as")[0]}, e as (select i // 1000 as block, x, unnest([0.1e0, 0.05e0, 0.02e0, 0.01e0]) as rel_eb from s), c as (select *, {_CODE} as code from e),
    h as (select block, rel_eb, code, count(*) as n from c group by all), t as (select block, rel_eb, sum(n) as t from h group by all), b as (select block, rel_eb, 32 / greatest(-sum(n / t * log2(n / t)), 0.01e0) as cr from h join t using (block, rel_eb) group by all),
    q as (select block, rel_eb, avg(pow(x - greatest(-1e0, least(1e0, 4 * rel_eb * code)), 2)) as mse, min(x) as lo, max(x) as hi from c group by all), w as (select * from b join q using (block, rel_eb))"""


def sweep_grid(spark, sf) -> DataFrame:
    bounds = spark.createDataFrame([(x,) for x in (0.1, 0.01, 0.001)], "rel_eb double")
    codecs = spark.createDataFrame([("fix",), ("ridge",), ("robust",)], "codec string")
    return S.grid(table(spark, sf, "nation").select(F.col("n_name").alias("dataset")), bounds, codecs).withColumn("label", S.bound_label(F.col("rel_eb")))


def sweep_merge(spark, sf) -> DataFrame:
    return rounded(S.merged(_sweep(spark, sf), ["rel_eb"]), "cr", "psnr")


def target_cr_grid(spark, sf) -> DataFrame:
    return rounded(S.nearest(_sweep(spark, sf), ["block"], 20.0), "cr")


def best_bound(spark, sf) -> DataFrame:
    return rounded(S.best(_sweep(spark, sf), ["block"], "rel_eb", "mse"), "mse")


def middle_block(spark, sf) -> DataFrame:
    return rounded(S.middle(_sweep(spark, sf), ["rel_eb"], ["block"]).select("rel_eb", "block", "cr"), "cr")


def _tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("dataset"), F.lit(0.01).alias("rel_eb"), F.lit("fix").alias("codec"), "n_nationkey", "n_regionkey")
    old = n.where("n_nationkey < 15").select("dataset", "rel_eb", "codec", F.col("n_nationkey").cast("double").alias("cr"), F.when(F.col("n_nationkey") % 3 != 0, 40.0 + F.col("n_regionkey")).alias("psnr"))
    new = n.where("n_nationkey >= 10").select("dataset", "rel_eb", "codec", (F.col("n_nationkey") * 2.0).alias("cr"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(50.0)).alias("psnr"))
    return old, new


_TABLES = """n as (select n_name as dataset, 0.01e0 as rel_eb, 'fix' as codec, n_nationkey as k, n_regionkey as r from nation), o as (select dataset, rel_eb, codec, k * 1e0 as cr, case when k % 3 <> 0 then 40e0 + r end as psnr from n where k < 15),
    w as (select dataset, rel_eb, codec, k * 2e0 as cr, case when k % 2 = 0 then 50e0 end as psnr from n where k >= 10)"""


def sweep_upsert(spark, sf) -> DataFrame:
    return S.upsert(*_tables(spark, sf))


def sweep_missing(spark, sf) -> DataFrame:
    old, new = _tables(spark, sf)
    return S.missing(new.select(*S.KEYS), old)


def sweep_wide(spark, sf) -> DataFrame:
    old, new = _tables(spark, sf)
    return S.wide(old.unionByName(new.withColumn("codec", F.lit("ridge"))), ["fix", "ridge"])


def model_ratio(spark, sf) -> DataFrame:
    """For each kind of event, bits of its values before over those of their codes under one model of all codes, and the plain mean of the codes' loss."""
    s = table(spark, sf, "events").select("event_type", F.col("value").alias("x"))
    r = B.value_range(s)
    codes = s.select("event_type", Q.toward_zero(B.normalize(F.col("x"), r["lo"], r["hi"]), BOUND).alias("code"))
    each = M.histogram(codes, by=["event_type"])
    shares = each.groupBy("code").agg(F.sum("n").alias("of")).select("code", (-F.log(F.col("of") / codes.agg(F.count("*")).scalar())).alias("loss"))
    total = each.join(shares, "code").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("loss")).alias("loss"))
    return rounded(total.select("event_type", M.ratio(32 * F.col("n"), F.col("loss") / F.log(F.lit(2.0))).alias("cr"), (F.col("loss") / F.col("n")).alias("loss")), "cr", "loss")


# catalogues and logs


def catalog_regex_median(spark, sf) -> DataFrame:
    names = spark.range(600).select(F.format_string("16_%d_%d_2048_%04d.bin", F.col("id") % 7 + 4, F.col("id") % 3 + 20, F.col("id") * 37 % 600).alias("name"))
    return raw.shape_catalog(names, r"^16_(\d+)_(\d+)_2048_(\d+)\.bin$", 3)


def renamed_bounds(spark, sf) -> DataFrame:
    names = table(spark, sf, "part").select("p_partkey", F.format_string("%de-0%d/part_%d.txt", F.col("p_size") % 9 + 1, F.col("p_partkey") % 9, F.col("p_partkey")).alias("name"))
    return names.select("p_partkey", raw.renamed_bounds(F.col("name")).alias("name"))


def log_scrape(spark, sf) -> DataFrame:
    lines = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("step done")).otherwise(F.format_string("CR=%d.25, PSNR = %d", F.col("o_custkey"), F.col("o_orderkey") % 90)).alias("value"))
    return raw.scraped(lines, {"cr": r"CR=([0-9.]+)", "psnr": r"PSNR = ([0-9.]+)"}).drop("value")


def plan_parse(spark, sf) -> DataFrame:
    lines = table(spark, sf, "nation").select(F.lit("p").alias("path"), F.col("n_nationkey").cast("int").alias("step"), F.format_string(" %d  %d 7 %d ", F.col("n_nationkey") + 1, F.col("n_regionkey") * 2, F.col("n_nationkey") + 200).alias("line"))
    p = raw.parsed_plan(lines)
    return p.select("step", F.element_at("shape", 1).alias("d0"), F.element_at("shape", 2).alias("d1"), F.size("shape").alias("ndim"), "stencil")


def block_files(spark, sf) -> DataFrame:
    return raw.block_files(spark, "array", [4, 3, 2])


def text_rows(spark, sf) -> DataFrame:
    return raw.text_rows(table(spark, sf, "documents")).select("doc_id")


LORENZO = [(1, 1), (2, 1), (3, 1), (4, 1), (1, 2), (2, 2), (3, 2)]

QUERIES = {
    f.__name__: f
    for f in (
        fold3d, unfold, explode_vectors, transpose, rotate, downsample, upsample, blockify, halo_gather, neighbour_gather, tile_merge, *(_lorenzo(*x) for x in LORENZO), block_regression_3d, previous_frame, predictability_by_axis, frame_stats,
        group_ranges, sampled_blocks, effective_rank, group_moments, stencil_catalog, stencil_neighbours, stencil_eligibility, level_assignment, pivots, level_plan, *map(_multilevel, codec.METHODS), plan_search, bitfield_decode, roi_slice,
        region_boxes, cross_correlation, subpixel_peak, frame_region_boxes, frame_cross_correlation, frame_subpixel_peak, sweep_grid, sweep_merge, target_cr_grid, best_bound, middle_block, sweep_upsert, sweep_missing, sweep_wide, model_ratio, catalog_regex_median, renamed_bounds, log_scrape,
        plan_parse, block_files, text_rows,
    )
}

_LEVEL = "case when i1 % 2 = 1 then 0 when i0 % 2 = 1 then 1 when i1 % 4 = 2 then 2 when i0 % 4 = 2 then 3 else 4 end"
SQL = {
    "multilevel_fix": _multilevel_sql(),
    "fold3d": f"with {SPACE} select i0, i1, i2, {R('x')} as x from a",
    "unfold": f"with {PLANE} select i, {R('x')} as x from s",
    "explode_vectors": f"select vec_id as i0, unnest(range(len(embedding))) as i1, {R('unnest(embedding)::double')} as x from embeddings",
    "transpose": f"with {SPACE} select i2 as i0, i0 as i1, i1 as i2, {R('x')} as x from a",
    "rotate": f"with {SPACE} select i0, {CUBE[1] - 1} - i2 as i1, i1 as i2, {R('x')} as x from a",
    "downsample": f"with {PLANE} select i0 // 4 as i0, i1 // 4 as i1, {R('x')} as x from a where i0 % 4 = 0 and i1 % 4 = 0",
    "upsample": f"with {PLANE} select i0 // 4 * 2 as i0, i1 // 4 * 2 as i1, {R('x')} as x from a where i0 % 4 = 0 and i1 % 4 = 0",
    "blockify": f"with {SPACE} select i0 // 4 as b0, i1 // 4 as b1, i2 // 4 as b2, count(*) as n, {R('sum(x)')} as total, max(i0 % 4) as p0, max(i1 % 4) as p1, max(i2 % 4) as p2 from a group by 1, 2, 3",
    "halo_gather": f"""with {PLANE}, b as (select distinct i0 // 16 as b0, i1 // 16 as b1 from a), e as (select distinct (i0 + u.d) // 16 as b0, (i1 + v.d) // 16 as b1, i0, i1, x from a, (select unnest([-1, 0, 1]) as d) u, (select unnest([-1, 0, 1]) as d) v where i0 + u.d >= 0 and i1 + v.d >= 0)
        select b0, b1, count(*) as n, count(*) filter (i0 // 16 = b0 and i1 // 16 = b1) as own, {R("sum(x)")} as total from e group by b0, b1""",
    "neighbour_gather": f"""with {PLANE} select a.i0, a.i1, {R("a.x")} as x, {R("l.x")} as n0, {R("r.x")} as n1, {R("u.x")} as n2, {R("d.x")} as n3 from a left join a l on l.i0 = a.i0 and l.i1 = a.i1 - 1 left join a r on r.i0 = a.i0 and r.i1 = a.i1 + 1
        left join a u on u.i0 = a.i0 - 1 and u.i1 = a.i1 left join a d on d.i0 = a.i0 + 1 and d.i1 = a.i1""",
    "tile_merge": f"""with z as (select max(event_id) + 1 as n, cast(ceil((max(event_id) + 1) / 300) as bigint) as k from events), t as (select range as tile, round_even(range * ((n - 300) / greatest(1, k - 1)), 0) as start from z, range((select k from z)))
        select event_id as i, {R('max_by(value + tile, tile)')} as x from events join t on event_id >= start and event_id < start + 300 group by event_id""",
    **{f"lorenzo{layers}_{ndim}d": _lorenzo_sql(ndim, layers) for ndim, layers in LORENZO},
    "block_regression_3d": f"""with {SPACE}, m as (select i0 // 5 as b0, i1 // 5 as b1, i2 // 5 as b2, regr_slope(x, i0 % 5) as c0, regr_slope(x, i1 % 5) as c1, regr_slope(x, i2 % 5) as c2, avg(x) as m, avg(i0 % 5) as p0, avg(i1 % 5) as p1, avg(i2 % 5) as p2, count(*) as n from a group by 1, 2, 3)
        select b0, b1, b2, {R("c0")} as c0, {R("c1")} as c1, {R("c2")} as c2, {R("m - c0 * p0 - c1 * p1 - c2 * p2")} as intercept, n from m""",
    "previous_frame": f"""with {PLANE}, d as (select x - coalesce(lag(x) over (partition by i1 order by i0), 0) as d from a) select cast(case when d >= 0 then ceil((d - {BOUND!r}e0) / {2 * BOUND!r}e0) else floor((d + {BOUND!r}e0) / {2 * BOUND!r}e0) end as bigint) as code, count(*) as n from d group by 1""",
    "predictability_by_axis": f"with {SPACE}, d as (" + " union all ".join(f"select 'i{k}' as axis, i{k} as p, (lag(x) over w + lead(x) over w) / 2 - x as e from a window w as (partition by {', '.join(f'i{j}' for j in range(3) if j != k)} order by i{k})" for k in range(3)) + f") select axis, {R('avg(e * e)')} as mse from d where p % 2 = 1 group by axis",
    "frame_stats": f"""with p as (select event_id // 100 as i0, floor(value / 10) as x from events) select i0, {R("avg(x)")} as mean, {R("quantile_cont(x, 0.5)")} as median, {R("stddev_pop(x)")} as std, {R("min(x)")} as min, {R("max(x)")} as max, {R("avg(x) filter (x <> 0)")} as mean_nonzero,
        {R("avg(case when x = 0 then 1e0 else 0e0 end) * 100")} as sparsity from p group by i0""",
    "group_ranges": "select c_mktsegment, min(c_acctbal) as lo, max(c_acctbal) as hi, count(*) as n from customer group by 1",
    "sampled_blocks": f"with {PLANE} select i0 // 20 as b0, i1 // 20 as b1, count(*) as n, {R('avg(x)')} as mean from a where (i0 % 20 < 3 or i0 % 20 >= 17) and (i1 % 20 < 3 or i1 % 20 >= 17) group by 1, 2",
    "group_moments": f"with v as (select label as i0, unnest(range(len(embedding))) as i1, unnest(embedding)::double as x from embeddings) select i0, i1, {R('avg(x)')} as mean, {R('stddev_pop(x)')} as std from v group by i0, i1 having stddev_pop(x) > 0",
    "stencil_catalog": f"with {_STENCILS} select cast(n as integer) as ndim, k as known, cast(t as bigint) as targets, cast(bit_count(k) as integer) as n_targets from c",
    "stencil_neighbours": f"""with {_STENCILS}, p as (select n, k, t, bit_count(v.v) as w from c, range(16) v(v) where (t::bigint >> v.v) & 1 = 1), l as (select n, k, t, min(w) as w from p group by n, k, t)
        select cast(n as integer) as ndim, k as known, cast(t as bigint) as targets, cast(sum(1 << w) as integer) as n_neighbours from p join l using (n, k, t, w) group by n, k, t""",
    "stencil_eligibility": f"with {_STENCILS} select k as known, cast(t as bigint) as targets from c where n = 3 and bit_count(k) = 4 and exists (select 1 from range(8) v(v) where (t::bigint >> v.v) & 1 = 1 and (v.v & 2) = 0)",
    "level_assignment": f"with {PLANE} select i0, i1, {_LEVEL} as level from a",
    "pivots": f"with {PLANE} select i0, i1, {R('x')} as x from a where i0 % 8 = 0 and i1 % 8 = 0",
    "level_plan": """with recursive p as (select 0 as step, 1 as s0, 1 as s1, 1 as s2 union all
        select step + 1, case when a = 0 then s0 * 2 else s0 end, case when a = 1 then s1 * 2 else s1 end, case when a = 2 then s2 * 2 else s2 end
        from (select *, case when s2 < 454 and s2 <= least(case when s1 < 390 then s1 else 99999 end, case when s0 < 256 then s0 else 99999 end) then 2 when s1 < 390 and s1 <= case when s0 < 256 then s0 else 99999 end then 1 else 0 end as a from p) where step < 25)
        select step, ((256 + s0 - 1) // s0) || ' ' || ((390 + s1 - 1) // s1) || ' ' || ((454 + s2 - 1) // s2) as shape from p where step < 26""",
    "bitfield_decode": "select event_id, cast((event_id * 7919 % 65536) // 16384 as integer) as gain, cast((event_id * 7919 % 65536) % 16384 as integer) as intensity from events",
    "roi_slice": f"with {PLANE} select i0, i1, {R('x')} as x from a where i0 >= 0 and i0 < 13 and i1 >= 35 and i1 < 65",
    "region_boxes": f"""with {_REGIONS}, g as (select region, count(*) as n, min(i0) as lo0, max(i0) as hi0, min(i1) as lo1, max(i1) as hi1 from p group by region)
        select *, hi0 - lo0 + 1 as size0, hi1 - lo1 + 1 as size1, (hi0 - lo0 + 1) // 2 as centre0, (hi1 - lo1 + 1) // 2 as centre1 from g""",
    "cross_correlation": f"with {_CROSS} select region, d0, d1, overlap, {R('cc', 5)} as cc, {R('sym', 5)} as sym, {R('reg', 5)} as reg from x",
    "subpixel_peak": f"""with {_CROSS}, t as (select region, arg_min(d0, (-cc, d0, d1)) as d0, arg_min(d1, (-cc, d0, d1)) as d1, max(cc) as c from x group by region), n as (select t.*, a.cc as m0, b.cc as p0, e.cc as m1, f.cc as p1 from t left join x a on a.region = t.region and a.d0 = t.d0 - 1 and a.d1 = t.d1
        left join x b on b.region = t.region and b.d0 = t.d0 + 1 and b.d1 = t.d1 left join x e on e.region = t.region and e.d0 = t.d0 and e.d1 = t.d1 - 1 left join x f on f.region = t.region and f.d0 = t.d0 and f.d1 = t.d1 + 1),
        u as (select *, nullif((m0 + p0 - 2 * c) / 2, 0) as a0, nullif((m1 + p1 - 2 * c) / 2, 0) as a1 from n), v as (select *, (m0 - p0) / 4 / a0 as s0, (m1 - p1) / 4 / a1 as s1 from u), h as (select *, c - a0 * s0 * s0 as h0, c - a1 * s1 * s1 as h1 from v)
        select region, d0, d1, {R("s0", 5)} as shift0, {R("s1", 5)} as shift1, {R("(h0 + h1) / 2", 5)} as contrast, case when h0 / a0 <= 0 then {R("sqrt(greatest(-h0 / 2 / a0, 0)) * 2.3548e0", 5)} end as fwhm0, case when h1 / a1 <= 0 then {R("sqrt(greatest(-h1 / 2 / a1, 0)) * 2.3548e0", 5)} end as fwhm1 from h""",
    "frame_region_boxes": f"""with {_MASKED}, g as (select frame, region, count(*) as n, min(i0) as lo0, max(i0) as hi0, min(i1) as lo1, max(i1) as hi1 from f where region <> 0 group by frame, region)
        select *, hi0 - lo0 + 1 as size0, hi1 - lo1 + 1 as size1, (hi0 - lo0 + 1) // 2 as centre0, (hi1 - lo1 + 1) // 2 as centre1 from g""",
    "frame_cross_correlation": f"""with {_LAGS} select frame, region, d0, d1, overlap, {R('cc', 5)} as cc, {R('case when abs(l * r) > 0 then cc * overlap / l / r else cc end', 5)} as sym, {R('cc / (overlap * ma * mb)', 5)} as reg from k join m using (frame, region)""",
    "sweep_grid": "select n_name as dataset, rel_eb, codec, case rel_eb when 0.1e0 then '1.0e-01' when 0.01e0 then '1.0e-02' else '1.0e-03' end as label from nation, (select unnest([0.1e0, 0.01e0, 0.001e0]) as rel_eb), (select unnest(['fix', 'ridge', 'robust']) as codec)",
    "sweep_merge": f"with {_SWEEP} select rel_eb, {R('count(*) / sum(1 / cr)')} as cr, {R('20 * log10(max(hi) - min(lo)) - 10 * log10(avg(mse))')} as psnr, count(*) as blocks from w group by rel_eb",
    "target_cr_grid": f"with {_SWEEP} select block, arg_min(rel_eb, (abs(cr - 20), rel_eb)) as rel_eb, {R('arg_min(cr, (abs(cr - 20), rel_eb))')} as cr from w group by block",
    "best_bound": f"with {_SWEEP} select block, arg_min(rel_eb, (-mse, rel_eb)) as rel_eb, {R('max(mse)')} as mse from w group by block",
    "middle_block": f"with {_SWEEP}, o as (select *, row_number() over (partition by rel_eb order by block) as r, count(*) over (partition by rel_eb) as n from w) select rel_eb, block, {R('cr')} as cr from o where r = n // 2 + 1",
    "sweep_upsert": f"with {_TABLES} select dataset, rel_eb, codec, coalesce(w.cr, o.cr) as cr, coalesce(w.psnr, o.psnr) as psnr from o full join w using (dataset, rel_eb, codec)",
    "sweep_missing": f"with {_TABLES} select dataset, rel_eb, codec from w where not exists (select 1 from o where o.dataset = w.dataset and o.cr is not null and o.psnr is not null)",
    "sweep_wide": f"""with {_TABLES}, u as (select * from o union all select dataset, rel_eb, 'ridge', cr, psnr from w) select dataset, rel_eb, max(cr) filter (codec = 'fix') as "fix_CR", max(psnr) filter (codec = 'fix') as "fix_PSNR", max(cr) filter (codec = 'ridge') as "ridge_CR", max(psnr) filter (codec = 'ridge') as "ridge_PSNR" from u group by dataset, rel_eb""",
    "model_ratio": f"""with r as (select min(value) as lo, max(value) as hi from events), d as (select event_type, 2e0 * (value - lo) / (hi - lo) - 1 as x from events, r),
        c as (select event_type, cast(case when x >= 0 then ceil((x - {BOUND!r}e0) / {2 * BOUND!r}e0) else floor((x + {BOUND!r}e0) / {2 * BOUND!r}e0) end as bigint) as code from d), h as (select code, count(*) as n from c group by code), t as (select sum(n) as t from h)
        select event_type, {R("32 * count(*) / sum(-log2(n / t))")} as cr, {R("avg(-ln(n / t))")} as loss from c join h using (code), t group by event_type""",
    "catalog_regex_median": """with f as (select printf('16_%d_%d_2048_%04d.bin', range % 7 + 4, range % 3 + 20, range * 37 % 600) as name, cast(range % 7 + 4 as integer) as k1, cast(range % 3 + 20 as integer) as k2 from range(600)),
        o as (select *, row_number() over (partition by k1, k2 order by name) as r, count(*) over (partition by k1, k2) as n from f) select k1, k2, name, n from o where r = n // 2 + 1""",
    "renamed_bounds": "select p_partkey, printf('%d.0e-0%d/part_%d.txt', p_size % 9 + 1, p_partkey % 9, p_partkey) as name from part",
    "log_scrape": "select o_orderkey, case when o_orderkey % 5 <> 0 then o_custkey + 0.25e0 end as cr, case when o_orderkey % 5 <> 0 then (o_orderkey % 90)::double end as psnr from orders",
    "plan_parse": "select cast(n_nationkey as integer) as step, cast(n_nationkey + 1 as integer) as d0, cast(n_regionkey * 2 as integer) as d1, 3 as ndim, cast(n_nationkey + 200 as integer) as stencil from nation",
    "block_files": "select 'array_' || a.range || '_' || b.range || '_' || c.range as name from range(4) a, range(3) b, range(2) c",
    "text_rows": r"select doc_id from documents where regexp_matches(text, '[^\s]')",
}

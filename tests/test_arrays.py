"""Array operators against numpy, their invariants, and the defined results of odd inputs."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from arrayq import registry
from arrayq.functions import bounds as B
from arrayq.functions import quantize as Q
from arrayq.operators import arrays as A
from arrayq.operators import entropy as E
from arrayq.operators import imaging as G
from arrayq.operators import metrics as M
from arrayq.operators import predict as P
from arrayq.operators import sweep as S
from arrayq.plans import codec, stencils, stream
from arrayq.runtime import reachable
from arrayq.sources import raw

SF = "/root/testdata/sf0.001"


def grid(spark, a):
    reachable(spark)
    at = list(np.ndindex(a.shape))
    cols = [f"i{k}" for k in range(a.ndim)]
    return spark.createDataFrame([(*map(int, i), float(a[i])) for i in at], ", ".join(f"{c} long" for c in cols) + ", x double")


def back(df, shape, value="y"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[f"i{k}"] for k in range(len(shape)))] = r[value]
    return out


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "orders", "customer", "part", "nation", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 4)
    return x


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == cols
    key = lambda rows: sorted(json.dumps([plain(x) for x in r]) for r in rows)
    assert key(got.select(cols).collect()) == key(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_constant_and_empty_arrays(spark):
    flat = grid(spark, np.full(17, 3.0))
    r = B.value_range(flat)
    assert {x[0] for x in flat.select(B.normalize(F.col("x"), r["lo"], r["hi"])).collect()} == {0.0}
    empty = flat.limit(0)
    assert M.report(empty.withColumn("y", F.col("x"))).first()["n"] == 0
    assert M.lag1_autocorrelation(flat.withColumnRenamed("i0", "i")).first()[0] == 0.0
    assert P.lorenzo(empty, 1).count() == 0 and A.gathered(empty, 1, [(1,)]).count() == 0
    assert M.run_lengths(empty.select(F.col("i0").alias("i"), F.col("x").alias("code"))).count() == 0


def test_both_tie_rules(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 1.0, -1.0, 3.0, -3.0, 2.9, 3.1)], "d double")
    got = d.select(Q.toward_zero(F.col("d"), 1.0).alias("t"), Q.away_from_zero(F.col("d"), 1.0).alias("a")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 1), (0, -1), (1, 2), (-1, -2), (1, 1), (2, 2)]


def test_runs_longer_than_blocks(spark):
    reachable(spark)
    codes = [1] * 30 + [2] * 1 + [3] * 9 + [1] * 20 + [1] * 0 + [2] * 2
    df = spark.createDataFrame(list(enumerate(codes)), "i long, code long")
    got = sorted((r.begin, r.code, r.length) for r in M.run_lengths(df, block=4).collect())
    want, at = [], 0
    for c, g in itertools.groupby(codes):
        n = len(list(g))
        want.append((at, c, n))
        at += n
    assert got == want


def test_shifted_respects_gaps_and_blocks(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(40) if i % 5], "i long, x double")
    for r in A.shifted(df, [-3, 2], block=8).collect():
        assert r.x_m3 == (float(r.i - 3) if r.i >= 3 and (r.i - 3) % 5 else None)
        assert r.x_p2 == (float(r.i + 2) if r.i + 2 < 40 and (r.i + 2) % 5 else None)


def test_catalogue_counts():
    count = lambda n: [sum(len(s.targets) == t for s in stencils.catalog(n)) for t in (8, 4, 2, 1)]
    assert count(4) == [15, 105, 105, 15] and count(3)[1:] == [7, 21, 7] and count(2)[2:] == [3, 3] and count(1)[3:] == [1]


@pytest.mark.parametrize("shape", [(17,), (1, 27), (5, 3, 1), (6, 7, 9)])
def test_every_cell_has_one_level(shape):
    plan = stencils.axis_plan(shape)
    assert len(plan) == sum(math.ceil(math.log2(d)) for d in shape)
    state = stencils.start(len(shape))
    seen = set()
    for step in plan:
        assert step.stride == state.stride
        for cell in np.ndindex(shape):
            if all(c % s == 0 for c, s in zip(cell, step.stride)):
                parity = sum((c // s % 2) << k for k, (c, s) in enumerate(zip(cell, step.stride)))
                if parity in step.stencil.targets:
                    assert cell not in seen
                    seen.add(cell)
        state = state.after(step.stencil)
    assert len(seen) == math.prod(shape) - 1


def test_quincunx_chain():
    s = stencils.start(2)
    diagonal = next(x for x in stencils.catalog(2) if x.known == (0, 3))
    s = s.after(diagonal)
    assert s.stride == (1, 1) and s.space == (0, 3)
    last = next(x for x in stencils.catalog(2) if x.known == (0,) and x.targets == (3,))
    assert stencils.eligible(s, (8, 8)) == [stencils.catalog(2).index(last)]
    assert s.after(last).stride == (2, 2)
    assert sorted(last.offsets()) == [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def smooth(shape, seed=3):
    a = np.cumsum(np.random.default_rng(seed).standard_normal(shape), 0)
    return 2 * (a - a.min()) / (a.max() - a.min()) - 1


@pytest.mark.parametrize(("method", "shape"), [*((m, (9, 7)) for m in codec.METHODS), ("cubic", (33,)), ("robust", (5, 4, 3)), ("ridge", (3, 3, 4, 2))])
def test_stream_round_trip(spark, method, shape, tmp_path):
    """Within the bound, and what is read back from the bytes is what the encoder had."""
    reachable(spark)
    a, plan = smooth(shape), stencils.axis_plan(shape, 2)
    made = codec.coded(grid(spark, a), shape, plan, 0.02, method, [8] * len(shape))
    y = back(made.cells, shape)
    assert np.abs(y - a).max() <= 0.02 * (1 + 1e-6) and (made.coefficients is not None) == codec.METHODS[method].fitted
    header, parts = stream.encoded(grid(spark, a), shape, plan, 0.02, method, [8] * len(shape), stretch=16)
    stream.write(header, parts, f"file://{tmp_path}/s")
    header, parts = stream.read(spark, f"file://{tmp_path}/s")
    assert np.array_equal(back(stream.decoded(header, parts), shape), y)
    of = {r.kind: (r.n, r.bytes) for r in stream.size(header, parts).collect()}
    assert of["code"][0] + of["stored"][0] == math.prod(shape) and set(of) == {"header", "table", "code", "stored", *(["coefficients"] if codec.METHODS[method].fitted else [])}


def test_stream_of_other_plans(spark):
    """Diagonal stencils, no steps at all, one cell, one value, a level plan longer than needed for pivots."""
    reachable(spark)
    quincunx = next(x for x in stencils.catalog(2) if x.known == (0, 3))
    last = next(x for x in stencils.catalog(2) if x.known == (0,) and x.targets == (3,))
    diagonal = [stencils.Step((1, 1), quincunx), stencils.Step((1, 1), last)]
    for a, plan in ((smooth((9, 10)), diagonal), (smooth((4, 5)), []), (np.zeros((1, 1)), []), (np.full((6, 3), 0.25), stencils.axis_plan((6, 3)))):
        header, parts = stream.encoded(grid(spark, a), a.shape, plan, 0.05, "fix", [4, 4], stretch=7)
        assert header.plan() == list(plan)
        assert np.abs(back(stream.decoded(header, parts), a.shape) - a).max() <= 0.05 * (1 + 1e-6)
    header, parts = stream.encoded(grid(spark, np.zeros((1, 1))).limit(0), (0, 3), [], 0.1)
    assert stream.decoded(header, parts).count() == 0


def test_own_method(spark):
    class First(codec.Method):
        """The first neighbour's value."""

        fitted = True

        def weights(self, rows, keys, xs, base, e, threshold):
            return rows.select(*keys).distinct().withColumn("w", F.array(*(F.lit(float(k == 0)) for k in range(len(xs)))))

    codec.METHODS["first"] = First()
    try:
        a, plan = smooth((12, 5)), stencils.axis_plan((12, 5), 2)
        header, parts = stream.encoded(grid(spark, a), a.shape, plan, 0.02, "first", [8, 8])
        assert np.abs(back(stream.decoded(header, parts), a.shape) - a).max() <= 0.02 * (1 + 1e-6)
    finally:
        del codec.METHODS["first"]
    with pytest.raises(ValueError, match="unknown method"):
        codec.compressed(grid(spark, a), a.shape, plan, 0.02, "first")


def test_threshold_sweep(spark):
    a = smooth((16, 12))
    a[::5] += 0.0
    rows = codec.threshold_sweep(grid(spark, a), a.shape, stencils.axis_plan(a.shape, 2), 0.02, [1.0, 9.0, 1e6], [8, 8]).collect()
    assert sorted(r.threshold for r in rows) == [1.0, 9.0, 1e6] and [r.bits for r in rows] == sorted(r.bits for r in rows)
    assert all(r.max_abs <= 0.02 * (1 + 1e-6) for r in rows)


@pytest.mark.parametrize("method", ["fix", "ridge"])
def test_losses_of_all_stencils_at_once(spark, method):
    """Each candidate's loss is that of the codec's own prediction with it."""
    a = smooth((8, 9))
    cells = grid(spark, a)
    state = stencils.start(2)
    got = {r.stencil: (r.loss, r.n) for r in codec.step_losses(cells, state, a.shape, [4, 16], method, 0.02).collect()}
    assert set(got) == set(stencils.eligible(state, a.shape)) and len(got) > 2
    for i, (loss, n) in got.items():
        step = stencils.Step(state.stride, stencils.catalog(2)[i])
        rows = codec.neighbours(cells.where(step.is_target()), cells.where(step.is_known()), step, a.shape, "x")
        xs, base = codec.regressors(step, a.shape, [4, 16])
        w = None if method == "fix" else P.robust_fit(codec.in_blocks(rows, [4, 16]), ["b0", "b1"], xs, F.col("x"), base)
        r = codec.with_weights(rows, w, xs, base, [4, 16]).agg(F.avg((F.col("x") - F.col("pred")) ** 2).alias("loss"), F.count("*").alias("n")).first()
        assert n == r.n and np.isclose(loss, r.loss, rtol=1e-5)


def test_ridge_matches_least_squares(spark):
    rng = np.random.default_rng(4)
    n, k, a = 60, 4, 1e-4
    x, base = rng.standard_normal((n, k)), [0.25] * k
    y = x @ [0.5, 0.1, 0.2, 0.3] + 0.01 * rng.standard_normal(n)
    y[:3] += 5
    df = spark.createDataFrame([(0, *map(float, r), float(t)) for r, t in zip(x, y)], "g long, a double, b double, c double, d double, y double")
    cols = [F.col(c) for c in "abcd"]

    def ridge(x, y):
        return np.linalg.lstsq(np.vstack([x, a * np.eye(k)]), np.concatenate([y, a * np.array(base)]), rcond=None)[0]

    w = ridge(x, y)
    assert np.allclose(P.robust_fit(df, ["g"], cols, F.col("y"), base).first()["w"], w)
    keep = np.abs(x @ w - y) <= 1.0
    assert np.allclose(P.robust_fit(df, ["g"], cols, F.col("y"), base, 1.0).first()["w"], ridge(x[keep], y[keep]))
    assert P.robust_fit(df, ["g"], cols, F.col("y"), base, -1.0).first()["w"] == base


def test_search_takes_the_best_axis(spark):
    a = np.tile(np.array([0.0, 0.9, 0.0, 0.9, 0.0, 0.9]), (8, 1)) - 0.5  # constant along axis 0
    plan, found = codec.searched(grid(spark, a), a.shape, 1, 0.02, "fix")
    first = plan[0].stencil
    assert first.known == (0, 2) and found[0][2] < 0.05


def test_huffman_round_trip(spark):
    rng = np.random.default_rng(5)
    codes = np.clip(rng.geometric(0.3, 3000), 1, 20) - 5
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "i long, code long")
    reachable(spark)
    packed, lengths = E.huffman_packed(df, 1000)
    assert sum(2.0 ** -n for n in lengths.values()) <= 1 + 1e-12 and E.table_from(E.table_bytes(lengths)) == lengths
    got = [r.code for r in E.huffman_unpacked(packed, lengths, 1000).orderBy("i").collect()]
    assert got == codes.tolist()
    bits = packed.agg(F.sum("bits")).first()[0]
    entropy = M.entropy(M.histogram(df)).first()["bits"]
    assert entropy <= bits / 3000 < entropy + 1
    with pytest.raises(ValueError):
        E.histogram_of(df, most=3)


def test_raw_files(spark, tmp_path):
    reachable(spark)
    a = np.linspace(-3, 70000, 50).astype("<f4")
    (tmp_path / "a.f32").write_bytes(a.tobytes())
    df = raw.read_raw(spark, f"file://{tmp_path}/a.f32")
    assert [r.x for r in df.orderBy("i").collect()] == a.astype(float).tolist()
    parts = raw.raw_blocks(df, "ui16", 16).orderBy("part").collect()
    assert np.array_equal(np.frombuffer(b"".join(p.content for p in parts), "<u2"), np.clip(np.rint(a.astype(float)), 0, 65535).astype("<u2"))
    (tmp_path / "bad.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole number"):
        raw.read_raw(spark, f"file://{tmp_path}/bad.f32").count()


def test_plan_files(spark, tmp_path):
    shape = (5, 9)
    plan = stencils.plan_table(spark, stencils.axis_plan(shape), shape).withColumn("path", F.lit("p"))
    raw.write_plan(plan, f"file://{tmp_path}/plans")
    got = raw.read_plan(spark, f"file://{tmp_path}/plans/path=p/*.txt")
    assert [(r.step, r["shape"], r.stencil) for r in got.orderBy("step").collect()] == [(r.step, r["shape"], r.stencil) for r in plan.orderBy("step").collect()]
    assert raw.plan_faults(got).count() == 0
    assert raw.plan_faults(got.where("step < 2")).first()["expected"] == 7


def test_speckle_shift(spark):
    rng = np.random.default_rng(6)
    a = rng.random((16, 16))
    b = np.roll(a, (-1, -2), (0, 1))
    pixels = grid(spark, a).withColumnRenamed("x", "a").join(grid(spark, b).withColumnRenamed("x", "b"), ["i0", "i1"]).withColumn("region", F.lit(1))
    c = G.correlation(pixels, (4, 4))
    p = G.peak(c.select("region", "d0", "d1", G.symmetric(c).alias("c")), ["region"]).first()
    assert (p.d0, p.d1) == (1, 2)


def test_bisection_ends():
    bound, value = S.bisected(lambda e: 100 * e, 1e-3, 1.0, 7.0)
    assert abs(value - 7) <= 0.07 and S.bisected(lambda e: 1.0, 1e-3, 1.0, 7.0, most=5)[1] == 1.0


def test_truncation_rank_and_standardized_fit(spark):
    reachable(spark)
    rng = np.random.default_rng(8)
    a = rng.standard_normal(20).astype(np.float32)
    got = [r.y for r in E.truncated(grid(spark, a), 2).orderBy("i0").collect()]
    assert got == (a.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32).astype(float).tolist()
    v = rng.standard_normal((200, 2)) @ rng.standard_normal((2, 6))
    df = spark.createDataFrame([(x.tolist(),) for x in v] + [(None,)], "v array<double>")
    values = np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1].clip(0)
    want = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    assert tuple(M.effective_rank(df, "v").first()) == (want, 6)
    x = rng.standard_normal((100, 2)) * [1.0, 50.0] + [3.0, 0.0]
    y = x @ [0.5, -0.2] + 7 + 0.001 * rng.standard_normal(100)
    rows = spark.createDataFrame([(0, *map(float, r), float(t)) for r, t in zip(x, y)] + [(1, 1.0, 2.0, 3.0)], "g long, a double, b double, y double")
    fits = {r.g: r for r in P.standardized_fit(rows, ["g"], [F.col("a"), F.col("b")], F.col("y"), [0.5, 0.5, 0.0], 1.0).collect()}
    plain_fit = np.linalg.lstsq(np.hstack([x, np.ones((100, 1))]), y, rcond=None)[0]
    assert fits[0].n == 100 and np.allclose(fits[0].w, plain_fit, atol=1e-5)
    assert fits[1].n == 0 and list(fits[1].w) == [0.5, 0.5, 0.0]


def test_frames_cover_the_whole_plane(spark, tmp_path):
    """Every frame and every column has its regions, lags and peaks, against sums over single cells."""
    reachable(spark)
    rng = np.random.default_rng(9)
    n = 4000  # 40 rows: three whole frames and four rows of a fourth
    v = rng.random(n)
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    x = (2 * (v - v.min()) / (v.max() - v.min()) - 1).reshape(40, 100)
    inside = lambda i, j: (i % 12 + j) % 7 != 0
    cells = {}
    for i, j in np.ndindex(x.shape):
        if inside(i, j):
            cells.setdefault((i // 12, j // 12 + 1), []).append((i % 12, j))
    boxes = {(r.frame, r.region): r for r in registry.QUERIES["frame_region_boxes"](spark, str(tmp_path)).collect()}
    assert {k: (len(c), min(c)[0], max(c)[0], min(j for _, j in c), max(j for _, j in c)) for k, c in cells.items()} == {k: (r.n, r.lo0, r.hi0, r.lo1, r.hi1) for k, r in boxes.items()}
    want = {}
    for (f, region), c in cells.items():
        pairs = [(i, j) for i, j in c if (f + 1) * 12 + i < 40]
        for i, j in pairs:
            for p, q in pairs:
                if abs(i - p) <= 3 and abs(j - q) <= 3:
                    k = (f, region, i - p, j - q)
                    cc, m = want.get(k, (0.0, 0))
                    want[k] = (cc + x[f * 12 + i, j] * x[(f + 1) * 12 + p, q], m + 1)
    got = {(r.frame, r.region, r.d0, r.d1): r for r in registry.QUERIES["frame_cross_correlation"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and {k[:2] for k in got} == {(f, g) for f in range(3) for g in range(1, 10)}
    assert all(got[k].overlap == m and abs(got[k].cc - cc) < 2e-5 for k, (cc, m) in want.items())
    top = {}
    for k, (cc, _) in want.items():
        top[k[:2]] = max(top.get(k[:2], (-np.inf,)), (cc, k[2:]))
    peaks = {(r.frame, r.region): (r.d0, r.d1) for r in registry.QUERIES["frame_subpixel_peak"](spark, str(tmp_path)).collect()}
    assert peaks == {k: at for k, (_, at) in top.items()}


def test_equal_errors_are_exact_ties(spark):
    """Where the mean stands for both Lorenzo predictions, their errors are the same to the last bit and the first by name is taken."""
    a = np.random.default_rng(10).random((100, 100))
    cells = grid(spark, a).repartition(8)
    errors = {(r.b0, r.b1, r.predictor): r.err for r in P.block_errors(cells, (5, 5), 10.0, F.lit(float(a.mean()))).collect()}
    assert len(errors) == 1200 and all(errors[i, j, "lorenzo1"] == errors[i, j, "lorenzo2"] for i, j in np.ndindex(20, 20))
    assert {r.predictor for r in P.selected(cells, (5, 5), 10.0, F.lit(float(a.mean()))).collect()} <= {"lorenzo1", "regression"}


@pytest.mark.parametrize("shape", [(67,), (23, 9), (7, 6, 5)])
def test_neighbours_meet_in_tiles(spark, shape, monkeypatch):
    """Over many small tiles as by single cells, and no cell is sent once for each of its neighbours."""
    reachable(spark)
    monkeypatch.setattr(codec, "TILE", 16)
    a = np.random.default_rng(11).random(shape) + 1
    cells, n = grid(spark, a), len(shape)
    for step in stencils.axis_plan(shape, 3):
        for own in (None, [tuple(o if k == n - 1 else 0 for k in range(n)) for o in (-3, -1, 1, 3)]):
            known = cells.where(step.is_known())
            rows = codec.neighbours(cells.where(step.is_target()), known, step, shape, "x", own)
            assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
            has = {tuple(r)[:n]: r.x for r in known.collect()}
            got = rows.collect()
            assert len(got) == cells.where(step.is_target()).count() > 0
            last = [(d - 1) // s * s for d, s in zip(shape, step.stride)]
            for r in got:
                assert r.x == a[tuple(r)[:n]]
                for m, o in enumerate(own or step.stencil.offsets()):
                    to = [i + q * s for i, q, s in zip(tuple(r)[:n], o, step.stride)]
                    to = tuple(to if own else (min(max(t, 0), x) for t, x in zip(to, last)))
                    assert r[f"n{m}"] == has.get(to, None if own else 0.0)


def test_correlation_in_tiles(spark):
    """Regions over several tiles, a gap, negative places, nulls: as by pairs of cells; no cell is sent once for each lag."""
    reachable(spark)
    rng = np.random.default_rng(12)
    cells = {(g, i, j): (float(rng.random()), float(rng.random())) for g in (1, 2) for i in range(-3, 5) for j in range(50, 140) if (i * j) % 5 != 1}
    cells[1, 0, 64] = (None, 0.5)
    pixels = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "region long, i0 long, i1 long, a double, b double")
    c = G.correlation(pixels, (1, 2))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = {}
    for (g, i, j), (_, b) in cells.items():
        for d in itertools.product((-1, 0, 1), (-2, -1, 0, 1, 2)):
            if (g, i + d[0], j + d[1]) in cells:
                a = cells[g, i + d[0], j + d[1]][0]
                w = want.setdefault((g, *d), [0.0, 0, 0.0, 0.0])
                w[:] = w[0] + (a or 0) * b, w[1] + 1, w[2] + (a or 0), w[3] + b
    got = {(r.region, r.d0, r.d1): r for r in c.collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert np.allclose([r.cc, r.overlap, r.left, r.right], want[k])
        of = [v for q, v in cells.items() if q[0] == k[0]]
        assert np.isclose(r.mean_a, np.mean([a for a, _ in of if a is not None])) and np.isclose(r.mean_b, np.mean([b for _, b in of]))

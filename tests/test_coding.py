"""Wavelet, entropy coder, byte forms, value levels and edge predictors against plain versions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayq.functions import bytes as Y
from arrayq.functions import interpolate as I
from arrayq.operators import ans, levels, wavelet
from arrayq.operators import entropy as E
from arrayq.operators import metrics as M
from arrayq.operators import predict as P
from arrayq.plans import codec, stencils
from arrayq.runtime import reachable
from arrayq.sources import raw


@pytest.mark.parametrize("size", [2, 4, 64])
def test_wavelet_round_trip_and_energy(spark, size):
    x = np.random.default_rng(size).standard_normal(size)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    c = wavelet.forward(df, size)
    got = {r.i: r.x for r in c.collect()}
    assert sorted(got) == list(range(size)) and np.isclose(sum(v * v for v in got.values()), (x**2).sum())
    back = {r.i: r.x for r in wavelet.backward(c, size).collect()}
    assert np.allclose([back[i] for i in range(size)], x)


def test_wavelet_against_its_definition(spark):
    x = np.random.default_rng(1).standard_normal(8)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    got = {r.i: r.x for r in wavelet.forward(df, 8, 1).collect()}
    for k in range(4):
        near = [x[(2 * k + j) % 8] for j in range(4)]
        assert np.isclose(got[k], np.dot(near, wavelet.LOW)) and np.isclose(got[4 + k], np.dot(near, wavelet.HIGH))
    assert wavelet.forward(df.limit(0), 8).count() == 0
    assert wavelet.forward(df, 8, 0).count() == 8
    for size, n in ((6, None), (8, 4)):
        with pytest.raises(ValueError):
            wavelet.forward(df, size, n)
    assert [wavelet.padded_size(n) for n in (1, 2, 3, 9)] == [2, 2, 4, 16]


@pytest.mark.parametrize("kind", ["skewed", "one", "flat", "short"])
def test_range_coder_round_trip(spark, kind):
    reachable(spark)
    rng = np.random.default_rng(2)
    codes = {"skewed": rng.geometric(0.7, 20000) * -3, "one": np.full(300, 7), "flat": rng.integers(-3000, 3000, 5000), "short": np.array([5, 6])}[kind]
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "i long, code long")
    rows, model = ans.packed(df, 4000)
    assert model[1].sum() == ans.SCALE and model[1].min() >= 1
    assert [r.code for r in ans.unpacked(rows, model, 4000).orderBy("i").collect()] == codes.tolist()
    if kind == "skewed":
        # the last states hold what goes beyond the 32 bits that they begin with
        written = [r.content for r in rows.collect()]
        held = sum(np.log2(np.frombuffer(c[: 8 * ans.LANES], "<u8")).sum() - 32 * ans.LANES + 8 * (len(c) - 8 * ans.LANES) for c in written)
        bits = M.entropy(M.histogram(df)).first()["bits"] * len(codes)
        assert abs(held / bits - 1) < 0.01
    assert ans.packed(df.limit(0))[0].count() == 0


def test_bytes(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, -1, 255, -32768, 32767, None)], "x long")
    for r in df.select("x", *(Y.to_bytes(F.col("x"), n).alias(f"b{n}") for n in (2, 4, 8)), *(Y.from_bytes(Y.to_bytes(F.col("x"), n), n).alias(f"y{n}") for n in (2, 4, 8))).collect():
        for n in (2, 4, 8):
            assert r[f"y{n}"] == r.x and (None if r[f"b{n}"] is None else bytes(r[f"b{n}"])) == (None if r.x is None else r.x.to_bytes(n, "big", signed=True))


def test_quadric_and_edges(spark):
    reachable(spark)
    a = np.random.default_rng(3).standard_normal((6, 7))
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i, j in np.ndindex(6, 7)], "i0 long, i1 long, x double")
    t, u = (np.indices((6, 7))[k] * 2.0 / (s - 1) - 1 for k, s in enumerate((6, 7)))
    want = np.linalg.lstsq(np.stack([np.ones_like(t), t, u, t * t, t * u, u * u], 2).reshape(42, 6), a.reshape(-1), rcond=None)[0]
    r = P.quadratic(df, (6, 7)).first()
    assert r.n == 42 and np.allclose(r.w, want, atol=1e-8)
    got = {(r.i0, r.i1): r.pred for r in P.mean_of_present(df, 2, [(-1, 0), (0, -1)]).collect()}
    assert got[0, 0] == 0.0 and np.isclose(got[0, 3], a[0, 2]) and np.isclose(got[2, 2], (a[1, 2] + a[2, 1]) / 2)


def test_levels(spark):
    rng = np.random.default_rng(4)
    x = 100 + 2.5 * rng.integers(0, 9, 4000) + 0.02 * rng.standard_normal(4000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    r = levels.fitted(df).first()
    assert r.levels == 9 and abs(r.start - 100) < 0.01 and abs(r.step - 2.5) < 0.01
    near = levels.predicted(df.where("x is not null"), r.start, r.step).agg(F.max(F.abs(F.col("x") - F.col("pred"))), F.max("level")).first()
    assert near[0] < 0.2 and near[1] == 8
    assert tuple(levels.fitted(df.limit(0)).first()) == (None, None, 0)
    assert levels.fitted(df.where("x is null").fillna(3.0)).first().levels == 0
    # evenly spread values have no levels
    spread = spark.createDataFrame([(float(v),) for v in rng.random(3000)], "x double")
    assert levels.fitted(spread, most=20).first().levels == 0


def test_divisions_are_the_best():
    x = np.sort(np.random.default_rng(5).random(9))
    for k, (cost, means) in enumerate(levels.divisions(np.ones(9), x, x * x, 4), 1):
        best = min(sum(((p - p.mean()) ** 2).sum() for p in np.split(x, c)) for c in combinations(range(1, 9), k - 1))
        assert np.isclose(cost, best) and len(means) == k


@pytest.mark.parametrize("width", [1, 5, 9, 33])
def test_packed_ints(spark, width):
    reachable(spark)
    codes = np.random.default_rng(width).integers(0, 1 << width, 1003)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "i long, code long")
    rows = E.bits_packed(df, width, 100)
    assert [r.code for r in E.bits_unpacked(rows, width, 100).orderBy("i").collect()] == codes.tolist()
    assert sum(len(r.content) for r in rows.collect()) == 10 * -(-100 * width // 8) + -(-3 * width // 8)
    with pytest.raises(Exception, match="a code outside"):
        E.bits_packed(df.withColumn("code", F.lit(1 << width)), width).collect()
    assert E.bits_packed(df.limit(0), width).count() == 0


def test_interpolation_slopes(spark):
    """Middles of parabolas' and monotone steps' neighbours; no overshoot at a kink."""
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (1.0, 2.0, 4.0, 8.0), (0.0, 1.0, 1.0, 0.0), (9.0, 1.0, 1.0, 9.0)], "a double, b double, c double, d double")
    got = [(r.p, r.q) for r in df.select(I.pchip(*map(F.col, "abcd")).alias("p"), I.akima(*map(F.col, "abcd")).alias("q")).collect()]
    assert np.allclose([g[0] for g in got], [0.5, 3 + (2 / 3 - 4 / 3) / 4, 1.0, 1.0])
    assert np.allclose(got[0][1], 0.5) and got[3][1] < 1


def test_cubic_method_is_exact_on_cubics(spark):
    reachable(spark)
    x = np.arange(33) / 16 - 1
    a = x**3 * 0.5 - 0.3 * x
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "i0 long, x double")
    step = stencils.axis_plan((33,), 1)[0]
    how = codec.METHODS["cubic"]
    rows = codec.neighbours(df.where(step.is_target()), df.where(step.is_known()), step, (33,), "x", how.offsets(step))
    rows = codec.predicted(rows, how, None, step, (33,), [64]).collect()
    assert all(np.isclose(r.pred, r.x) for r in rows if 3 <= r.i0 <= 29) and len(rows) == 16
    assert all(abs(r.pred - r.x) < 1e-3 for r in rows)
    diagonal = stencils.Step((1, 1), next(x for x in stencils.catalog(2) if x.known == (0, 3)))
    with pytest.raises(ValueError, match="one axis"):
        how.offsets(diagonal)


def test_retagged_and_missing(spark):
    names = spark.createDataFrame([("a.qoz",), ("a.qoz2",), ("b.qoz",), (None,), ("c",)], "name string")
    assert sorted(map(tuple, raw.retagged(names, "qoz", "qoz2").collect())) == [("a.qoz", "a.qoz2", True), ("b.qoz", "b.qoz2", False)]
    assert sorted(r.name for r in raw.missing(names.where("name is not null"), names.where("name = 'c'")).collect()) == ["a.qoz", "a.qoz2", "b.qoz"]

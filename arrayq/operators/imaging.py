"""Frame stacks: pixel decoding, regions of interest and their correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks of a raw pixel, and full width at half maximum over standard deviation.
GAIN_MASK, INTENSITY_MASK, FWHM = 0xC000, 0x3FFF, 2.3548
#: Side of the tiles that a correlation is summed in; cells that are worked on at once, beside those of one tile.
TILE, ROWS = 64, 1 << 16
SUMS = {"cc": "double", "overlap": "long", "left": "double", "right": "double", "sum_a": "double", "sum_b": "double", "n_a": "long", "n_b": "long"}


def gain(raw: Column) -> Column:
    return F.shiftright(raw.bitwiseAND(F.lit(GAIN_MASK)), 14)


def intensity(raw: Column) -> Column:
    return raw.bitwiseAND(F.lit(INTENSITY_MASK))


def region_of_interest(df: DataFrame, centre: Sequence[int], width: Sequence[int], axes: Sequence[str] = ("i0", "i1")) -> DataFrame:
    """Cells with max(0, centre - width // 2) <= i < centre + width // 2 on each axis; a filter that reaches the scan."""
    out = df
    for c, m, w in zip(axes, centre, width, strict=True):
        out = out.where((F.col(c) >= max(0, m - w // 2)) & (F.col(c) < m + w // 2))
    return out


def region_boxes(mask: DataFrame, region: str = "region", by: Sequence[str] = ()) -> DataFrame:
    """(by, region, n, lo0, hi0, lo1, hi1, size0, size1, centre0, centre1) of the cells of each region; region 0 and null are outside."""
    a = mask.where(F.col(region) != 0).groupBy(*by, region).agg(F.count("*").alias("n"), *(f(f"i{k}").alias(f"{n}{k}") for k in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))))
    size = {f"size{k}": F.col(f"hi{k}") - F.col(f"lo{k}") + 1 for k in (0, 1)}
    return a.withColumns(size).withColumns({f"centre{k}": F.expr(f"size{k} div 2") for k in (0, 1)})


def correlation(pixels: DataFrame, lags: Sequence[int], by: Sequence[str] = ("region",)) -> DataFrame:
    """(by, d0, d1, cc, overlap, left, right, mean_a, mean_b): linear cross correlation of a and b of pixels(by, i0, i1, a, b).

    cc sums a(i + d) * b(i), overlap counts the pairs of cells, left sums a(i + d) and right b(i) over them, for |d_k| <= lags[k].
    Cells are sent to their tile and to those they are near to; a tile's sums for all lags are made where its cells are.
    """
    keys, shifts = [*by, "__t0", "__t1"], list(product(*(range(-m, m + 1) for m in lags)))
    rows = pixels.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in (*by, "i0", "i1"))))
    rows = rows.select(*by, *(F.col(c).cast("long").alias(c) for c in ("i0", "i1")), *(F.col(c).cast("double").alias(c) for c in "ab"))
    for k, m in enumerate(lags):
        tile = lambda o: F.floor((F.col(f"i{k}") + o) / TILE)  # noqa: B023, E731
        rows = rows.withColumn(f"__t{k}", F.explode(F.sequence(tile(-m), tile(m))))
    own = reduce(Column.__and__, (F.col(f"__t{k}") == F.floor(F.col(f"i{k}") / TILE) for k in (0, 1)))
    rows = rows.withColumn("__own", own).repartition(*keys).sortWithinPartitions(*keys, "i0", "i1")
    width = TILE + 4 * lags[1]  # of a tile's row of places, so that a lag stays in its row

    def sums(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        """Of whole tiles that begin at the rows ``first``: a row for each tile with cells of its own and each lag."""
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
        i0, i1, t0, t1 = (t.column(c).to_numpy() for c in ("i0", "i1", "__t0", "__t1"))
        at = (group * (TILE + 4 * lags[0]) + i0 - t0 * TILE + 2 * lags[0]) * width + i1 - t1 * TILE + 2 * lags[1]
        a, b = (t.column(c).fill_null(0.0).to_numpy() for c in "ab")
        no_a, no_b = (t.column(c).is_null().to_numpy() for c in "ab")
        mine = np.flatnonzero(t.column("__own").to_numpy())
        tiles, of = np.unique(group[mine], return_inverse=True)
        add = lambda of, x: np.bincount(of, x, len(tiles))
        there = lambda of, x, no: pa.array(add(of, x), mask=add(of, ~no) == 0)
        whole = [there(of, a[mine], no_a[mine]), there(of, b[mine], no_b[mine]), *(pa.array(add(of, ~no[mine]).astype(np.int64)) for no in (no_a, no_b))]
        out = []
        for d0, d1 in shifts:
            to = at[mine] + d0 * width + d1
            p = np.minimum(np.searchsorted(at, to), len(at) - 1)
            met = np.flatnonzero(at[p] == to)
            x, y, g = p[met], mine[met], of[met]
            columns = [there(g, a[x] * b[y], no_a[x] | no_b[y]), pa.array(np.bincount(g, minlength=len(tiles))), there(g, a[x], no_a[x]), there(g, b[y], no_b[y]), *whole]
            out.append(pa.RecordBatch.from_arrays([*(t.column(c).take(pa.array(first[tiles])).combine_chunks() for c in by), *(pa.array(np.full(len(tiles), d)) for d in (d0, d1)), *columns], [*by, "d0", "d1", *(c for c in SUMS)]))
        return pa.Table.from_batches(out).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, size = [], 0  # cells of tiles that may go on in the next batch

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, size
            t = pa.Table.from_batches(rest).combine_chunks()
            new = reduce(np.logical_or, (pc.not_equal(t.column(c).slice(1), t.column(c).slice(0, len(t) - 1)).to_numpy() for c in keys))
            first = np.append(0, np.flatnonzero(new) + 1)
            end = len(t) if last else int(first[-1])
            if end:
                yield from sums(t.slice(0, end), first[first < end]).to_batches()
            rest = t.slice(end).to_batches()
            size = sum(map(len, rest))

        for b in batches:
            if len(b):
                rest, size = [*rest, b], size + len(b)
                if size >= ROWS:
                    yield from done(False)
        if size:
            yield from done(True)

    kinds = [*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "d0 long, d1 long", *(f"{c} {k}" for c, k in SUMS.items())]
    parts = rows.mapInArrow(run, ", ".join(kinds)).groupBy(*by, "d0", "d1").agg(*(F.sum(c).alias(c) for c in SUMS))
    means = [F.try_divide(f"sum_{c}", f"n_{c}").alias(f"mean_{c}") for c in "ab"]
    return parts.where("overlap > 0").select(*by, "d0", "d1", "cc", "overlap", "left", "right", *means)


def symmetric(c: DataFrame) -> Column:
    """cc * overlap / (left * right) where neither is zero, else cc."""
    return F.when(F.abs(c["left"] * c["right"]) > 0, c["cc"] * c["overlap"] / c["left"] / c["right"]).otherwise(c["cc"])


def regular(c: DataFrame) -> Column:
    """cc over the overlap and both mean values."""
    return c["cc"] / (c["overlap"] * c["mean_a"] * c["mean_b"])


def peak(corr: DataFrame, by: Sequence[str], value: str = "c") -> DataFrame:
    """(by, d0, d1, shift0, shift1, contrast, fwhm0, fwhm1): the largest value and the parabolas through it and its neighbours.

    Of equal ones the first by d0, d1.  A peak without both neighbours on an axis has null there.
    """
    one = corr.groupBy(*by).agg(F.collect_list(F.struct((-F.col(value)).alias("v"), "d0", "d1")).alias("all"))  # as many as there are lags
    one = one.withColumn("p", F.array_min("all")).select(*by, "all", (-F.col("p.v")).alias("top"), F.col("p.d0").alias("p0"), F.col("p.d1").alias("p1"))
    at = lambda k, o: -F.get(F.filter("all", lambda c: (c["d0"] == F.col("p0") + (o if k == 0 else 0)) & (c["d1"] == F.col("p1") + (o if k == 1 else 0))), F.lit(0))["v"]
    both = one.select(*by, "top", "p0", "p1", *(at(k, o).alias(f"{s}{k}") for k in (0, 1) for s, o in (("u", -1), ("v", 1))))
    bend = {k: (F.col(f"u{k}") + F.col(f"v{k}") - 2 * F.col("top")) / 2 for k in (0, 1)}
    both = both.withColumns({f"a{k}": F.when(b != 0, b) for k, b in bend.items()})
    both = both.withColumns({f"shift{k}": (F.col(f"u{k}") - F.col(f"v{k}")) / 4 / F.col(f"a{k}") for k in (0, 1)})
    both = both.withColumns({f"h{k}": F.col("top") - F.col(f"a{k}") * F.col(f"shift{k}") * F.col(f"shift{k}") for k in (0, 1)})
    width = lambda k: F.when(F.col(f"h{k}") / F.col(f"a{k}") <= 0, F.sqrt(-F.col(f"h{k}") / 2 / F.col(f"a{k}")) * FWHM)
    return both.select(*by, F.col("p0").alias("d0"), F.col("p1").alias("d1"), "shift0", "shift1", ((F.col("h0") + F.col("h1")) / 2).alias("contrast"), width(0).alias("fwhm0"), width(1).alias("fwhm1"))

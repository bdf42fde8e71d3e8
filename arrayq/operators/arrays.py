"""Arrays as coordinate tables (i0, i1, ..., x) and as blocks.

Nothing here needs an array, or even a row of it, in one task.  Neighbours on an axis are found by windows
over stretches of ``BLOCK`` cells with a halo; neighbours at any offsets by scattering every value to the cells
that want it and one grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def axes(ndim: int) -> list[str]:
    return [f"i{k}" for k in range(ndim)]


def fold(df: DataFrame, shape: Sequence[int], index: str = "i") -> DataFrame:
    """Row-major position ``index`` as coordinates; the first axis may be as long as it needs, its size is not used."""
    out, step = {}, 1
    for k in range(len(shape) - 1, 0, -1):
        out[f"i{k}"] = F.expr(f"({index} div {step}) % {shape[k]}").cast("long")
        step *= shape[k]
    out["i0"] = F.expr(f"{index} div {step}").cast("long")
    return df.withColumns({c: out[c] for c in axes(len(shape))})


def unfold(df: DataFrame, shape: Sequence[int], index: str = "i") -> DataFrame:
    """Coordinates as row-major position."""
    at = F.lit(0).cast("long")
    for k, size in enumerate(shape):
        at = at * (size if k else 1) + F.col(f"i{k}")
    return df.withColumn(index, at)


def explode_vectors(df: DataFrame, row: str, vector: str) -> DataFrame:
    """A column of vectors as a matrix (i0: row, i1: place, x)."""
    return df.select(F.col(row).alias("i0"), F.posexplode(vector).alias("i1", "x")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("x").cast("double").alias("x"))


def transpose(df: DataFrame, order: Sequence[int]) -> DataFrame:
    """Axis k of the result is axis order[k]."""
    keep = [c for c in df.columns if c not in axes(len(order))]
    return df.select(*(F.col(f"i{o}").alias(f"i{k}") for k, o in enumerate(order)), *keep)


def rotate(df: DataFrame, width: int) -> DataFrame:
    """The (i1, i2) planes turned by a quarter, so that what was on the right (of ``width`` columns) comes up."""
    return df.withColumns({"i1": F.lit(width - 1) - F.col("i2"), "i2": F.col("i1")})


def downsample(df: DataFrame, ndim: int, step: int) -> DataFrame:
    """Every step-th cell on each axis."""
    out = df
    for c in axes(ndim):
        out = out.where(F.col(c) % step == 0)
    return out.withColumns({c: F.expr(f"{c} div {step}") for c in axes(ndim)})


def upsample(df: DataFrame, ndim: int, step: int) -> DataFrame:
    """The inverse: cells at every step-th place."""
    return df.withColumns({c: F.col(c) * step for c in axes(ndim)})


def blocked(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Block number b_k and place p_k in the block for each axis."""
    cols = {f"b{k}": F.expr(f"i{k} div {s}") for k, s in enumerate(sizes)} | {f"p{k}": F.col(f"i{k}") % s for k, s in enumerate(sizes)}
    return df.withColumns(cols)


def with_halo(df: DataFrame, sizes: Sequence[int], halo: int = 1) -> DataFrame:
    """Rows by block, each block with ``halo`` cells of its neighbours around it (own: whether a cell is the block's own).

    Only cells near an edge are repeated, at most 2 ** ndim times for halo < size; a block is then worked on without its neighbours.
    """
    out = df
    for k, s in enumerate(sizes):
        i = F.col(f"i{k}")
        near = F.array(*(F.expr(f"(i{k} + {o}) div {s}") for o in (-halo, 0, halo)))
        out = out.withColumn(f"b{k}", F.explode(F.array_distinct(F.filter(near, lambda b: b >= 0)))).where(i >= 0)
    own = F.lit(True)
    for k, s in enumerate(sizes):
        own = own & (F.col(f"b{k}") == F.expr(f"i{k} div {s}"))
    return out.withColumn("own", own)


def shifted(df: DataFrame, offsets: Sequence[int], by: Sequence[str] = (), index: str = "i", values: Sequence[str] = ("x",), block: int = BLOCK) -> DataFrame:
    """df with columns ``{value}_m1, {value}_p2, ...``: the values at index - 1, index + 2, ...; null where there is no such row.

    (by, index) is unique.  A stretch of ``block`` cells and its halo makes one window partition, so a single long array is
    spread over all tasks.
    """
    far = max(map(abs, offsets))
    near = F.array_distinct(F.transform(F.array(F.lit(-far), F.lit(0), F.lit(far)), lambda o: F.floor((F.col(index) + o) / block).cast("long")))
    rows = df.withColumn("__block", F.explode(near))
    cols = {}
    for o in offsets:
        w = Window.partitionBy(*by, "__block").orderBy(index).rangeBetween(o, o)
        cols |= {named(v, o): F.max(v).over(w) for v in values}
    return rows.withColumns(cols).where(F.col("__block") == F.floor(F.col(index) / block)).drop("__block")


def named(value: str, offset: int) -> str:
    return f"{value}_{'m' if offset < 0 else 'p'}{abs(offset)}"


def gathered(df: DataFrame, ndim: int, offsets: Sequence[Sequence[int]], value: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """(by, i0.., value, n0, n1, ...): values at i + offsets[k]; null outside.

    Each value is sent to the cells it is a neighbour of; one aggregation brings a cell's neighbours together.
    """
    all_ = [(0,) * ndim, *map(tuple, offsets)]
    targets = F.array(*(F.struct(*((F.col(f"i{a}") - o[a]).alias(f"i{a}") for a in range(ndim)), F.lit(k).alias("k")) for k, o in enumerate(all_)))
    sent = df.select(*by, F.col(value).alias("__v"), F.explode(targets).alias("__t")).select(*by, "__t.*", "__v")
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("__v")))
    out = sent.groupBy(*by, *axes(ndim)).agg(F.max(F.col("k") == 0).alias("__is"), of(0).alias(value), *(of(k + 1).alias(f"n{k}") for k in range(len(offsets))))
    return out.where("__is").drop("__is")


def tile_starts(size: int, tile: int) -> list[int]:
    """Where overlapping tiles of one axis begin: evenly spread, the first at 0 and the last at the end; halves round to even."""
    n = -(-size // tile)
    return [0] if n <= 1 else [round(k * (size - tile) / (n - 1)) for k in range(n)]


def tiled(df: DataFrame, size: int, tile: int, index: str = "i") -> DataFrame:
    """A row for each tile that covers a cell (tile: number, from 0); the starts follow from the sizes, so this is an explode, not a range join."""
    n = -(-size // tile)
    k = F.expr(f"explode(sequence(0, {n - 1}))") if n > 1 else F.lit(0)
    start = F.bround(F.col("tile") * ((size - tile) / max(1, n - 1))).cast("long")
    reach = df.withColumn("tile", k) if n <= 4 else df.withColumn("__k", F.floor(F.col(index) * (n - 1) / max(1, size - tile)).cast("long")).withColumn("tile", F.explode(F.expr(f"filter(sequence(__k - {2 + tile * (n - 1) // max(1, size - tile)}, __k + 2), t -> t between 0 and {n - 1})"))).drop("__k")
    return reach.withColumn("start", start).where((F.col("start") <= F.col(index)) & (F.col(index) < F.col("start") + tile))


def merge_tiles(df: DataFrame, keys: Sequence[str], value: str = "x") -> DataFrame:
    """One value for each cell: that of the last tile."""
    return df.groupBy(*keys).agg(F.max_by(value, "tile").alias(value))


def scalar_of(df: DataFrame, expr: Column) -> Column:
    """A one-row aggregate as a value in other queries."""
    return df.agg(expr).scalar()

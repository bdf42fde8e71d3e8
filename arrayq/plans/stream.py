"""A compressed array as bytes: header, stored cells, coefficients and codes, and all of it read back.

A stream has one row for each part: (kind, level, part, n, content).  Parts of the codes go from the coarsest level to the finest, as a
decoder needs them.  A part holds the codes of the level's cells in one stretch of its grid, in row-major order, so that no
position is stored: which cells these are follows from the plan.  Codes are Huffman coded by one table for the whole array;
stored cells and coefficients are numbers under zstd.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bounds as B
from ..operators import entropy as E
from ..operators.arrays import axes
from . import codec
from .stencils import Step, catalog

STRETCH = 1 << 18
SCHEMA = "kind string, level int, part long, n long, content binary"


@dataclass(frozen=True)
class Header:
    """What a decoder has to know beside the parts; lo and hi are the range that the values were taken from."""

    shape: tuple[int, ...]
    strides: tuple[tuple[int, ...], ...]
    stencils: tuple[int, ...]
    e: float
    method: str
    sizes: tuple[int, ...]
    ratio: float = B.LEVEL_RATIO
    stretch: int = STRETCH
    lo: float = -1.0
    hi: float = 1.0

    def plan(self) -> list[Step]:
        return [Step(tuple(t), catalog(len(self.shape))[i]) for t, i in zip(self.strides, self.stencils, strict=True)]

    def stride(self, level: int) -> tuple[int, ...]:
        """Of the grid that a level's cells lie on; the stored ones are what the last step keeps."""
        return tuple(self.strides[min(level, len(self.strides) - 1)]) if self.strides else (1,) * len(self.shape)

    def grid(self, level: int) -> list[int]:
        return [-(-d // t) for d, t in zip(self.shape, self.stride(level), strict=True)]

    def cells(self, level: int, part: int) -> np.ndarray:
        """(cells, axes): coordinates of a part's cells, in order."""
        grid, stride = self.grid(level), self.stride(level)
        at = np.arange(part * self.stretch, min((part + 1) * self.stretch, int(np.prod(grid, dtype=object))))
        x = np.stack(np.unravel_index(at, grid), 1).astype(np.int64) if len(at) else np.zeros((0, len(grid)), np.int64)
        if not self.strides:
            return x
        step = self.plan()[min(level, len(self.strides) - 1)]
        parity = ((x & 1) << np.arange(len(grid))).sum(1)
        return x[np.isin(parity, step.stencil.targets if level < len(self.strides) else step.stencil.known)] * np.array(stride)

    def place(self) -> Column:
        """Of a cell in its level's grid, row-major."""
        out = F.lit(None).cast("long")
        for level in range(len(self.strides), -1, -1):
            at = F.lit(0).cast("long")
            for k, (d, t) in enumerate(zip(self.grid(level), self.stride(level), strict=True)):
                at = at * d + F.expr(f"i{k} div {t}")
            out = F.when(F.col("level") == level, at).otherwise(out)
        return out


def _packed(rows: DataFrame, header: Header, values: Sequence[str], kind: str, pack) -> DataFrame:
    """Parts of rows(level, place, values): pack(values, each as an array) is a part's content."""
    grouped = rows.groupBy("level", F.expr(f"place div {header.stretch}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", *values))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(c) for c in values]
            content = [pack(*(x[r].values for x in lists)) for r in range(len(b))]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(b)), b.column("level"), b.column("part"), b.column("n"), pa.array(content, pa.binary())], ["kind", "level", "part", "n", "content"])

    each = lambda v: F.transform("all", lambda s: s[v]).alias(v)
    flat = grouped.select("level", "part", F.size("all").cast("long").alias("n"), *map(each, values))
    return flat.mapInArrow(run, SCHEMA)


def encoded(df: DataFrame, shape: Sequence[int], plan: Sequence[Step], e: float, method: str = "fix", sizes: Sequence[int] | None = None, stretch: int = STRETCH, lo: float = -1.0, hi: float = 1.0, threshold: float = codec.THRESHOLD) -> tuple[Header, DataFrame]:
    """(header, parts) of a dense array df(i0.., x) with values in [-1, 1], as in codec.coded().  An empty array has no parts but the empty code table."""
    ndim = len(shape)
    sizes = tuple(sizes or [codec.BLOCKS[ndim]] * ndim)
    ids = {s: i for i, s in enumerate(catalog(ndim))}
    header = Header(tuple(shape), tuple(p.stride for p in plan), tuple(ids[p.stencil] for p in plan), float(e), method, sizes, stretch=stretch, lo=lo, hi=hi)
    made = codec.coded(df, shape, plan, e, method, sizes, header.ratio, threshold)
    cells = made.cells.withColumn("place", header.place())
    lengths = E.huffman_lengths(counts) if (counts := E.histogram_of(cells.where("code is not null"))) else {}
    book = E.canonical(lengths)
    codes = _packed(cells.where("code is not null"), header, ["code"], "code", lambda c: E.encoded(c.to_numpy(), book)[1])
    stored = _packed(cells.where("code is null"), header, ["y"], "stored", lambda y: zstandard.compress(y.to_numpy().astype("<f8").tobytes()))
    table = df.sparkSession.createDataFrame([("table", -1, 0, len(lengths), E.table_bytes(lengths))], SCHEMA)
    out = table.unionByName(stored).unionByName(codes)
    if made.coefficients is not None:
        keys = codec.block_keys(ndim)
        at = F.lit(0).cast("long")
        for k, (d, s) in enumerate(zip(shape, sizes, strict=True)):
            at = at * -(-d // s) + F.col(keys[k])
        # a block's number, then its coefficients' codes
        rows = made.coefficients.select("level", at.alias("place"), F.concat(F.array(at), "codes").alias("codes"))
        out = out.unionByName(_packed(rows, header, ["codes"], "coefficients", lambda c: zstandard.compress(c.flatten().to_numpy().astype("<i8").tobytes())))
    return header, out


def decoded(header: Header, parts: DataFrame) -> DataFrame:
    """(i0.., y) of every cell of the array."""
    ndim, plan, names = len(header.shape), header.plan(), axes(len(header.shape))
    table = parts.where("kind = 'table'").select("content").first()[0]
    book = E.canonical(E.table_from(table))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, level, part, n, content in zip(*(b.column(c).to_pylist() for c in ("kind", "level", "part", "n", "content")), strict=True):
                x = header.cells(level, part)
                if len(x) != n:
                    raise ValueError(f"part {part} of level {level} has {n} of {len(x)} cells")
                none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())
                code = pa.array(E.decoded(content, n, book)) if kind == "code" else none[0]
                y = pa.array(np.frombuffer(zstandard.decompress(content), "<f8")) if kind == "stored" else none[1]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(ndim)), pa.array(np.full(n, level, np.int32)), code, y], [*names, "level", "code", "y"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for level, n, content in zip(*(b.column(c).to_pylist() for c in ("level", "n", "content")), strict=True):
                rows = np.frombuffer(zstandard.decompress(content), "<i8").reshape(n, -1)
                at = np.unravel_index(rows[:, 0], [-(-d // s) for d, s in zip(header.shape, header.sizes, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, level, np.int32)), *(pa.array(x.astype(np.int64)) for x in at), pa.array(rows[:, 1:].tolist(), pa.list_(pa.int64()))], ["level", *codec.block_keys(ndim), "codes"])

    codes = parts.where("kind in ('code', 'stored')").mapInArrow(cells, ", ".join(f"{c} long" for c in names) + ", level int, code long, y double")
    coefficients = None
    if codec.method_named(header.method).fitted:
        coefficients = parts.where("kind = 'coefficients'").select("level", "n", "content").mapInArrow(blocks, "level int, " + ", ".join(f"{c} long" for c in codec.block_keys(ndim)) + ", codes array<bigint>")
    return codec.decompressed(codes, header.shape, plan, header.e, header.ratio, coefficients, header.sizes, header.method)


def size(header: Header, parts: DataFrame) -> DataFrame:
    """(kind, n, bytes) of a stream, the header among them."""
    of = parts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.length("content")).alias("bytes"))
    return of.unionByName(parts.sparkSession.createDataFrame([("header", 1, len(json.dumps(asdict(header))))], "kind string, n long, bytes long"))


def write(header: Header, parts: DataFrame, path: str) -> None:
    """The header as a line of JSON, the parts as Parquet, in the order of emission within each file."""
    spark = parts.sparkSession
    spark.createDataFrame([(json.dumps(asdict(header)),)], "value string").coalesce(1).write.text(f"{path}/header")
    parts.sortWithinPartitions("kind", F.col("level").desc(), "part").write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    h = json.loads(spark.read.text(f"{path}/header").first()[0])
    return Header(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in h.items()}), spark.read.schema(SCHEMA).parquet(f"{path}/parts")

"""Raw arrays, level plans, catalogues and logs as tables, and raw arrays back to files.

Files are read by Spark's own readers, so any store that Spark can open will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw cell types: numpy's name.
TYPES = {"f32": "<f4", "f64": "<f8", "ui16": "<u2", "i32": "<i4", "i64": "<i8"}
#: Values per task of an array that is written, and per batch of one that is read.
STRETCH = 1 << 20


def read_raw(spark: SparkSession, path: str, kind: str = "f32") -> DataFrame:
    """(path, i, x): the values of each headerless little-endian file in order, x as double.

    A file is one row of Spark's binary reader (2 GB at most), so large arrays are kept as many block files; its values
    leave the task in batches.  A file whose size isn't a multiple of the cell's raises an error.
    """
    dtype = np.dtype(TYPES[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % dtype.itemsize:
                    raise ValueError(f"{path}: {len(raw)} bytes are no whole number of {kind} cells")
                x = raw.view(dtype)
                for at in range(0, len(x), STRETCH):
                    part = x[at : at + STRETCH]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part.astype(float))], ["path", "i", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, i long, x double")


def raw_value(x: Column, kind: str) -> Column:
    """A value as the raw type holds it: unsigned 16-bit ones are rounded and clamped."""
    if kind == "ui16":
        return F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.bround(x))).cast("int")
    return x.cast({"f32": "float", "f64": "double", "i32": "int", "i64": "long"}[kind])


def raw_blocks(df: DataFrame, kind: str = "f32", stretch: int = STRETCH) -> DataFrame:
    """(part, n, content): bytes of stretches of an array (i, x) with consecutive i, each in one row; concatenated by part they are the file."""
    dtype = np.dtype(TYPES[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.asarray(v, float) for v in b.column("xs").to_pylist()]
            if kind == "ui16":
                data = [np.clip(np.rint(v), 0, 65535) for v in data]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([len(v) for v in data], pa.int64()), pa.array([v.astype(dtype).tobytes() for v in data], pa.binary())], ["part", "n", "content"])

    grouped = df.groupBy(F.expr(f"i div {stretch}").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("xs"))
    return grouped.mapInArrow(run, "part long, n long, content binary")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(path, step, shape, stencil): level-plan files of lines ``d0 .. dN-1 id``, step counted from 0, finest first.

    A file is read whole; it has a line for each halving of an axis.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.trim("value"), r"\s*\n\s*")).alias("step", "line"))
    return parsed_plan(lines.where("line <> ''"))


def parsed_plan(lines: DataFrame) -> DataFrame:
    """(path, step, shape, stencil) of lines(path, step, line)."""
    words = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("int"))
    return lines.select("path", "step", F.slice(words, 1, F.size(words) - 1).alias("shape"), F.element_at(words, -1).alias("stencil"))


def plan_faults(plan: DataFrame) -> DataFrame:
    """(path, steps, expected): plans whose length isn't the sum over the axes of ceil(log2 size)."""
    halvings = F.aggregate(F.col("first.shape"), F.lit(0), lambda a, d: a + F.ceil(F.log2(d.cast("double"))).cast("int"))
    a = plan.groupBy("path").agg(F.count("*").alias("steps"), F.min(F.struct("step", "shape")).alias("first"))
    return a.select("path", "steps", halvings.alias("expected")).where("steps <> expected")


def write_plan(plan: DataFrame, path: str) -> None:
    """Plans as text, one line a step, one folder for each path value; a plan's few lines make one file."""
    line = F.concat_ws(" ", F.transform("shape", lambda d: d.cast("string")), F.col("stencil").cast("string"))
    lines = plan.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("l")).select("path", F.concat_ws("\n", F.transform("l", lambda x: x["line"])).alias("value"))
    lines.write.partitionBy("path").mode("overwrite").text(path)


def shape_catalog(files: DataFrame, pattern: str, groups: int, name: str = "name") -> DataFrame:
    """(k1.., name, n): of the file names that the pattern matches, the middle one for each of the pattern's groups' values but the last."""
    from ..operators.sweep import middle

    keys = {f"k{g}": F.regexp_extract(name, pattern, g).cast("int") for g in range(1, groups + 1)}
    rows = files.where(F.col(name).rlike(pattern)).withColumns(keys)
    by = [f"k{g}" for g in range(1, groups)]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return middle(rows, by, [name]).join(counts, by).select(*by, name, "n")


def renamed_bounds(name: Column) -> Column:
    """Error bounds in file names with one decimal: 5e-03 becomes 5.0e-03; those that have one stay."""
    return F.regexp_replace(name, r"(?<![\d.])([1-9])e-0(\d)", "$1.0e-0$2")


def retagged(names: DataFrame, old: str, new: str, name: str = "name") -> DataFrame:
    """(name, renamed, taken): names with the tag ``old``, and what they become with ``new`` in its place; taken: there is a file of that name.

    Names that have the new tag stay out.
    """
    target = F.replace(F.col(name), F.lit(old), F.lit(new))
    some = names.where(F.contains(F.col(name), F.lit(old)) & ~F.contains(F.col(name), F.lit(new))).select(name, target.alias("renamed"))
    there = names.select(F.col(name).alias("renamed")).distinct().withColumn("taken", F.lit(True))
    return some.join(there, "renamed", "left").select(name, "renamed", F.coalesce("taken", F.lit(False)).alias("taken"))


def missing(wanted: DataFrame, there: DataFrame, name: str = "name") -> DataFrame:
    """The wanted files that are not there; null names are missing."""
    return wanted.join(there.select(name).distinct(), name, "left_anti")


def scraped(lines: DataFrame, patterns: dict[str, str], line: str = "value") -> DataFrame:
    """A log's lines with the first group of each pattern as a number, null where it doesn't match."""
    return lines.select("*", *(F.regexp_extract(line, p, 1).try_cast("double").alias(k) for k, p in patterns.items()))


def text_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that have more than blanks."""
    return df.where(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0)


def block_files(spark: SparkSession, base: str, counts: list[int]) -> DataFrame:
    """(name) of every block file of an array cut into counts[k] parts on axis k: base_<i0>_<i1>.."""
    out = spark.range(counts[0]).select(F.col("id").alias("i0"))
    for k, n in enumerate(counts[1:], 1):
        out = out.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.select(F.concat(F.lit(base), *(x for k in range(len(counts)) for x in (F.lit("_"), F.col(f"i{k}").cast("string")))).alias("name"))

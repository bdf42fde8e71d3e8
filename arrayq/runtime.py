"""What a query needs from the session it is given."""

from __future__ import annotations

import tempfile
import uuid
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package, wherever the driver was started.

    On a cluster the package is installed or sent with --py-files.
    """
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def query(f):
    """A query or stage whose first argument is the session; its texts may be long, so Arrow batches have fewer rows than by default."""

    @wraps(f)
    def run(spark: SparkSession, *args):
        reachable(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        return f(spark, *args)

    return run


def fresh(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, which all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:  # only where the cluster names no folder, as in tests
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/arrays/{uuid.uuid4().hex}"


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as Parquet under ``spark.checkpoint.dir`` and read again, so that lost executors cost no recomputation of it.

    by: a column of few values that each have a folder, so that a filter by it reads no other rows.
    """
    path = fresh(df.sparkSession)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


class Levels:
    """Tables of one schema, added level by level and read as one with the column level; each is saved as by saved()."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema, self.path = spark, schema, fresh(spark)

    def add(self, level: int, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/level={level}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, level int").parquet(self.path)

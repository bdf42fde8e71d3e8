"""Intermediate tables in the cluster's shared folder, so that lost executors cost no recomputation of what is written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; only a session without that setting gets a local folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tables/{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends here, and the shuffle files of the write are deleted when it ends."""
    spark = df.sparkSession
    path = folder(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that saved() wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has such a column already."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df without the rows whose column is among the ids (a table of one column); nulls stay, whatever other columns df has."""
    key = unused(df, "removed")
    return df.join(ids.toDF(key), df[column] == F.col(key), "left_anti")

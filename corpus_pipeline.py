"""Corpus preparation: each stage works on what the one before it kept, written as Parquet in between.

All stages but the last return the columns of documents, whatever these are called.  Null and empty texts are kept unless the classifier rejects
them; they are never copies, lose nothing, hold no test item, and are packed as their end alone.  Rows with a null doc_id pass the
first four stages as they are.  doc_id should be unique: rows that repeat one are dropped together by the first and the fourth stage,
stay together in the second, lose the same words in the third if their texts are equal, and are packed one by one.  Of equal texts the
one with the smallest doc_id stays.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arrayq.llm import classifier, decontaminate, near_dup, packing, substring_dedup
from arrayq.llm.store import saved, without
from arrayq.runtime import query


@query
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; all of them if there are no labels."""
    return classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates (five words, similarity 0.8 or more)."""
    return without(docs, near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "doc_id")


@query
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that a document with a smaller id has; a text may become empty."""
    return substring_dedup.deduplicate(docs)


@query
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold half of a benchmark item; all of them if there are no items."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packing.packed(docs)


STAGES = [("quality_classifier", quality), ("minhash_near_dup", near_duplicates), ("substring_dedup", substrings), ("benchmark_decontamination", decontamination), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs


#: No SQL can express a trained classifier; tests hold the stages against plain versions.
ORACLE_SQL = None

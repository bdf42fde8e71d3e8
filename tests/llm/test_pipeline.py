"""The pipeline's stages over the small tables, each against a plain version of its decision."""

import corpus_pipeline
from arrayq.llm.store import saved
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = saved(stage(spark, docs, SF))
        before, after = ({r.doc_id: r.text for r in d.select("doc_id", "text").collect()} if "text" in d.columns else None for d in (docs, out))
        if k < 4:
            assert out.columns == columns and set(after) <= set(before)
            kept[name] = len(after)
        if name == "minhash_near_dup":
            near = brute.near(list(before.items()), 5)
            assert set(after) == {d for d, x in near.items() if x[2]}
        if name == "substring_dedup":
            want = brute.substring(list(before.items()))
            for d, t in after.items():
                assert len(brute.words(t)) == want[d][0] - want[d][1]
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(before)
        docs = out
    assert kept["quality_classifier"] > 0


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, and extra columns that clash with names inside."""
    path = f"file://{tmp_path}/sf"
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    for t, df in (("labels", labels), ("benchmark", items)):
        df.limit(0).write.parquet(f"{path}/{t}.parquet")
    clash = docs.limit(60).unionByName(docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)))
    clash = clash.select("*", *(F.lit(1).alias(c) for c in ("removed", "kept", "component_id", "begins", "cut_id", "item_id", "row", "sequence", "accepted", "size")))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, saved(clash.limit(0)), path).count() == 0
        out = stage(spark, saved(clash), path)
        if name != "best_fit_packing":
            assert out.columns == clash.columns and out.where("doc_id is null").count() == 1
        if name in ("quality_classifier", "benchmark_decontamination"):
            assert out.count() == 61

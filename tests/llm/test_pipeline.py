"""The pipeline, stage by stage, against what each operator decides."""

import collections

import corpus_pipeline
from stepwell.llm import common, mixing, quality_rules


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels)[0].where("kept").collect()}
    seen, want = docs, kept
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = common.stage(f(spark, seen, sf), name)
        assert out.columns == docs.columns
        ids = collections.Counter(r.doc_id for r in out.collect())
        if name == "quality_rules":
            assert set(ids) == want and max(ids.values()) == 1
        elif name == "mixing":
            assert ids == {r.doc_id: r.copies for r in mixing.copies(seen).where("copies > 0").collect()}
        else:
            assert set(ids) < {r.doc_id for r in seen.collect()} and max(ids.values()) == 1
        seen = out
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    tokens = packed.where("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in tokens} == {k: v for k, v in collections.Counter(r.doc_id for r in seen.collect()).items()}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]

"""The pipeline's stages, each judged on its own input."""

import hashlib

import corpus_pipeline
from namesieve.llm import exact_dedup, quality_rules, simhash
from namesieve.workspace import work_folder, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outputs = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SF), f"{work_folder(spark)}/{number}")
        outputs.append((docs, out))
        docs = out
    for before, after in outputs[:-1]:
        assert after.columns == columns and after.count() > 0
    (raw, ruled), (_, exact), (_, near), (_, mixed), (_, tokens) = outputs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = quality_rules.judged(raw, labels).filter("verdict.kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in ruled.collect()) == sorted(r.doc_id for r in verdicts)
    last = {}
    for r in ruled.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(last.values())
    groups = simhash.near_groups(exact).select("component_id").distinct().collect()
    assert sorted(r.doc_id for r in near.collect()) == sorted(r.component_id for r in groups)
    texts = {r.doc_id: r.text for r in near.collect()}
    assert {r.doc_id for r in mixed.collect()} <= set(texts) and mixed.count() <= 2 * len(texts)
    for r in tokens.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert tokens.count() == mixed.count() == corpus_pipeline.run(spark, SF).count()
    assert exact_dedup.exact_groups(exact).filter("not kept").count() == 0

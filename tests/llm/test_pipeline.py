"""The pipeline's stages against their operators, and on hard and empty inputs."""

import corpus_pipeline
from briefloom.llm import decontaminate, ngram_join, packing


def test_stages_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"file://{tmp_path}/{k}")
        seen[name], docs = (docs, out), spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and not docs.isEmpty()
    before, _ = seen["near_duplicates"]
    gone = {r.doc_id for r in ngram_join.ngram_jaccard_join(before).where("not kept").collect()}
    after = {r.doc_id for r in seen["benchmark_decontamination"][0].collect()}
    assert gone and not gone & after and gone | after == {r.doc_id for r in before.collect()}
    bad = {r.doc_id for r in decontaminate.contaminated(seen["benchmark_decontamination"][0], spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    left = {r.doc_id for r in seen["secret_scan"][0].collect()}
    assert left == after - bad
    final = docs.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id for r in final} == left
    assert sorted(packing.pack(seen["packing"][0]).columns) == sorted(docs.columns)


def test_run_equals_the_stages(spark, small, tmp_path):
    """Row by row, what the operators give one after the other."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
    got = corpus_pipeline.run(spark, small)
    assert got.count() > 150 and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.select(*got.columns).collect()))


def test_stages_on_nulls_and_nothing(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, None, None), (2, "a b", "en", None, 3), (3, None, "en", "s", 0), (2, "a b", "en", None, 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns

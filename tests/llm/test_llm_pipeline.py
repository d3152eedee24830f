import corpus_pipeline
from test_llm_jaccard_join import brute
from tidemark.llm import pii


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, at = docs.columns, docs
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_copies", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, corpus_pipeline.written(stage(spark, at, sf_dir))
        assert at.columns == columns
        ids, left = {r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in at.select("doc_id").collect()}
        assert left <= ids
        if name == "near_copies":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert left == {v[4] for v in brute(rows).values()}
        if name == "personal_data":
            assert left == ids
            assert not [r for r in at.collect() if pii.base_spans(r.text)]
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in at.collect()}


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        assert made.count() == 0

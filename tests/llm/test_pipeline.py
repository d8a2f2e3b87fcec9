"""The pipeline's stages, each on its own input."""

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert out.count() <= n
            assert (out.count() == n) == (name == "personal_data"), name
            docs, n = out, out.count()
    assert out.count() > 0 and out.where("copies < 1 or copies > 3").count() == 0


def test_stages_take_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0

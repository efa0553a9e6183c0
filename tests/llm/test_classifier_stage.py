"""The classifier stage without usable labels."""

import pytest

import corpus_pipeline

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("labels", [[], [(99, 1, 0)], [(1, 1, 0)], [(3, 0, 0), (5, 0, 0)]])
def test_classifier_stage_keeps_documents_when_there_is_nothing_to_learn(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"a clean text number {i}", "en", "s", 20) for i in range(8)], DDL)
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 8

"""The pipeline against its stages' brute-force meaning."""

import pytest

pytest.importorskip("quarryline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    from tests_llm_data import write_tables

    want = write_tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(got.doc_id) == want
    assert len(corpus_pipeline.STAGES) == 5

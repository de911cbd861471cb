"""The mixing stage decides the order of a shard's slots."""

import pytest

pytest.importorskip("quarryline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quarryline.llm import mixing, sharding  # noqa: E402


def test_slots_follow_the_schedule(spark, tmp_path):
    from tests_llm_data import write_tables

    want = write_tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 1000")
    kept = kept.join(spark.createDataFrame([(i,) for i in want], "doc_id long"), "doc_id", "left_semi")
    place = {r.doc_id: (r.mix_slot, r.mix_place) for r in mixing.scheduled(kept).collect()}
    assert len(place) == len(got)
    for _, g in got.groupby("shard"):
        order = [place[i] for i in g.sort_values("slot").doc_id]
        assert order == sorted(order) and sorted(g.slot) == list(range(len(g)))


@pytest.mark.parametrize("numbered", [50_000, 40])
def test_slots_follow_the_target_weights(spark, monkeypatch, numbered):
    monkeypatch.setattr(sharding, "NUMBERED", numbered)
    docs = spark.createDataFrame([(i, f"{i:06d}" + "x" * 93, "en", "abc"[i % 3]) for i in range(600)], "doc_id long, text string, lang string, source string")
    weights, block = {"a": 0.5, "b": 0.3, "c": 0.2}, 1000
    slots = sharding.kd_shards(mixing.scheduled(docs, weights, block), 1, order=("mix_slot", "mix_place")).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(600))
    size = {s: 0 for s in "abc"}
    for n, r in enumerate(slots[:380], 1):  # before the first source ends
        size["abc"[r.doc_id % 3]] += 100
        assert all(abs(size[s] - w * 100 * n) <= 2 * block for s, w in weights.items())

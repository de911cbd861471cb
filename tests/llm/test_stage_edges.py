"""Every operator and stage on one messy table: nulls in any column, empty and very long
texts, ties, repeated rows, extra columns with clashing names; and on empty tables."""

import random

import pytest

pytest.importorskip("quarryline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quarryline.llm import chat, decontaminate, hmm_lm, html_extract, mixing, ngram_join, quality, sharding, topk, toxicity  # noqa: E402

EXTRA = ["own_row", "own_size", "rh", "node", "h", "label", "held_out", "score", "shard", "bucket", "size", "mix_block", "component", "key", "part", "row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, prose(1, 40), "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t", "en", None), (4, prose(2, 60_000), "en", "a"), (5, "x" * 300_000, "de", "b"), (6, prose(3, 50), "en", "a"), (6, prose(3, 50), "en", "a"), (6, prose(3, 50), "fr", "b")]
    rows += [(7 + i, prose(4, 50), "en", "ab"[i % 2]) for i in range(6)]  # ties in text
    rows += [(20 + i, prose(20 + i, 30 + i), "en", "abc"[i % 3]) for i in range(40)]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *([7] * len(EXTRA))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    out = str(tmp_path_factory.mktemp("edges"))
    docs.write.parquet(f"{out}/documents.parquet")
    labels = [(20 + i, i % 2, int(i < 2)) for i in range(40)] + [(None, 1, 1), (21, None, None), (20, 1, 1), (999, 0, 0), (22, 7, -1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, prose(77, 20)), (None, prose(78, 20)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def key(r):
    return repr(r)


def test_every_stage_keeps_columns_and_rows(spark, docs, folder):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        extra = ["mix_block", "mix_slot", "mix_place"] if name == "mixing" else []
        assert [c for c in out.columns if c not in extra] == [c for c in now.columns if c not in extra], name
        same = [c for c in now.columns if c not in extra]
        kept, had = sorted(map(key, out.select(*same).collect())), sorted(map(key, now.select(*same).collect()))
        assert set(kept) <= set(had), name
        if name in ("decontamination", "mixing"):
            assert kept == had, name
        if name == "ngram_join":
            assert sum("text=None" in k or "text=''" in k for k in kept) == 3 and sum(k.startswith("Row(doc_id=6,") for k in kept) == 1
        now = spark.createDataFrame(out.collect(), out.schema)
    shards = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert sorted(r.doc_id or -1 for r in shards.collect()) == sorted(r.doc_id or -1 for r in now.collect())


def test_every_stage_takes_an_empty_table(spark, docs, folder):
    now = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.count() == 0, name
        now = spark.createDataFrame([], out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() == 0


def test_every_operator_on_documents(spark, docs, folder):
    n = docs.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = [toxicity.score(docs, labels).toPandas(), quality.score(docs, labels).toPandas()]
    for got, least in zip(scores, (toxicity.THRESHOLD, quality.THRESHOLD), strict=True):
        assert len(got) == n and got.score.between(0, 1).all() and ((got.score >= least) == (got.predicted == 1)).all()
        assert not got[got.doc_id.isna()].held_out.any()
        # equal texts have equal scores
        assert got[got.doc_id.between(7, 12)].score.nunique() == 1
    told = hmm_lm.score(docs, passes=1).toPandas()
    assert len(told) == n and (told[told.doc_id.isin([1, 2, 3])].n_tokens == 1).all() and told[told.doc_id.between(7, 12)].score.nunique() == 1
    groups = ngram_join.join_components(docs).toPandas()
    assert len(groups) == n and (groups[groups.doc_id.between(7, 12)].component_id == 7).all()
    assert len(sharding.shard_digest(docs).toPandas()) == n
    assert mixing.scheduled(docs).count() == n
    assert decontaminate.find_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0


def test_every_operator_on_empty_tables(spark, docs, folder):
    none, labels = docs.where("false"), spark.read.parquet(f"{folder}/labels.parquet")
    for got in (toxicity.score(none, labels), quality.score(none, labels), toxicity.score(none, labels.where("false")), hmm_lm.score(none), ngram_join.join_components(none), sharding.shard_digest(none), mixing.scheduled(none), decontaminate.find_leaks(none, spark.read.parquet(f"{folder}/benchmark.parquet"))):
        assert got.count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert topk.topk_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

"""Names that clash, groups of copies and hot keys."""

import random

import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import mixing, ngram_join, sharding  # noqa: E402


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_size", "_hash", "_bucket", "_row", "_start", "_turn", "_slot", "_s", "_b", "_k", "own_size", "own_s", "mix slot", "a`b"]
    rows = [(i, f"text {i}", "en", "ab"[i % 2], *range(i, i + len(names))) for i in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    got = mixing.scheduled(docs, {"a": 0.7, "b": 0.3}, 50)
    assert got.columns == [*docs.columns, "mix_block", "mix_slot", "mix_place"]
    assert sorted(tuple(r)[: len(docs.columns)] for r in got.collect()) == sorted(rows)


def test_set_join_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 7, 8, 9), (2, text, 6, 5, 4), (1, text, 1, 1, 1), (3, None, 0, 0, 0)], "doc_id long, text string, _row long, own_row long, rh long")
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    rows = {tuple(r) for r in kept.collect()}
    assert (3, None, 0, 0, 0) in rows and len(rows) == 2 and rows <= {tuple(r) for r in docs.collect()}
    # repartitioned rows give the same choice
    assert {tuple(r) for r in ngram_join.one_of_each_group(docs.repartition(3)).collect()} == rows


def test_shards_keep_equal_texts_together_and_are_near_equal(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        text = " ".join(rng.choice("abcdefgh") * rng.randrange(2, 9) for _ in range(rng.randrange(5, 120)))
        for _ in range(rng.choice((1, 1, 1, 1, 2, 5))):
            rows.append((len(rows), text, rng.choice(("en", "de", None)), rng.choice(("a", "a", "a", "b", "c"))))
    got = sharding.kd_shards(table(spark, rows), 16).toPandas()
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() < 1.05 * sizes.mean() and sizes.min() > 0.95 * sizes.mean()


def test_only_a_group_above_an_even_shard_is_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)  # so that the group is one of those sent to tasks
    rows = [(i, "hot " * 50, "en", "a") for i in range(400)]
    rows += [(1000 + i, f"text {i} " * 25, "en", "abc"[i % 3]) for i in range(800)] + [(5000 + i, f"group {i // 8} " * 20, "de", "b") for i in range(160)]
    got = sharding.kd_shards(table(spark, rows), 10).toPandas()
    pieces = got.groupby("text_crc32").shard.nunique()
    assert (pieces > 1).sum() == 1 and pieces.max() > 1
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 10 and sizes.max() < 1.15 * sizes.mean()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows)


def test_target_bytes(spark):
    rows = [(i, f"{i:084d}", "en", "a" if i % 3 else "b") for i in range(600)]
    got = sharding.kd_shards(table(spark, rows), target_bytes=10_000).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 6 and sizes.max() <= 10_600


def test_sharding_of_columns_that_clash(spark):
    names = ["large", "part", "bytes", "k", "node", "tie", "pos", "size", "h", "row_hash", "shard", "bucket"]
    docs = spark.createDataFrame([(i, f"t{i}", *([1] * len(names))) for i in range(30)], ["doc_id", "text", *names])
    got = sharding.kd_shards(docs, 3).toPandas()
    assert sorted(got.doc_id) == list(range(30)) and set(got.shard) == {0, 1, 2}

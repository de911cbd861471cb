"""The registered hybrid search fuses both rankings."""

from collections import defaultdict

from quarryline.plans.queries import QUERIES

import __spark_entry__ as entry

SENTENCES = ["red apples grow here", "blue skies over there", "green apples fall down", "nothing at all", "red skies tonight"]
VECTORS = [[1.0, 0.0], [0.0, 1.0], [0.9, 0.1], [0.5, 0.5], [-1.0, 0.0]]


def test_hybrid_search_fuses_words_and_vectors(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(SENTENCES)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "red apples"), (1, "skies")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(VECTORS)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    sparse = QUERIES["bm25_topk"](spark, str(tmp_path)).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    score = defaultdict(float)
    for r in sparse:
        score[r.query_id, r.id] += 1 / (60 + r.rank)
    for q in (0, 1):
        for rank, i in enumerate(sorted(range(5), key=lambda i: (-round(dot(VECTORS[q], VECTORS[i]), 6), i)), 1):
            score[q, i] += 1 / (60 + rank)
    got = {(r.query_id, r.id): r.score for r in QUERIES["hybrid_search"](spark, str(tmp_path)).collect()}
    assert len(sparse) < len(got) == 10 and got == {k: round(v, 9) for k, v in score.items()}


def test_flagship_is_fused(spark):
    assert "score" in entry.entry(spark).columns and "rrf" in entry.queries() and "rrf" in entry.oracle_sql()

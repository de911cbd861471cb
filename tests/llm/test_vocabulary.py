"""Quality by words alone: the same case and marks, another vocabulary."""

import random

import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import quality  # noqa: E402


def test_junk_with_clean_marks_is_told_from_prose(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[:200] if i % 3 else words[100:]) for _ in range(60))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).toPandas()
    held = got[got.held_out]
    assert ((held.score >= 0.5) == (held.doc_id % 3 != 0)).mean() > 0.9

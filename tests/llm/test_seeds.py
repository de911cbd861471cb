"""Leaks whose unedited trigrams are the item's commoner ones."""

import random

import numpy as np
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import decontaminate  # noqa: E402
from quarryline.llm import textbytes as tb  # noqa: E402


def test_common_trigrams_are_seeds_too(spark):
    item = [f"q{k}" for k in range(20)]
    copy = [f"other{k}" if k % 4 == 3 else w for k, w in enumerate(item)]
    clean = [(10 + k, " ".join(f"c{k}_{j}" for j in range(30)) + " " + " ".join(item[k : k + 3])) for k in range(0, 20, 4)]
    docs = spark.createDataFrame([*clean, (1, " ".join(copy))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 7, 0.65)]
    assert decontaminate.without_leaks(docs, bench).where("doc_id = 1").count() == 0


def edited(rng, words, rate):
    """Words with a share of them replaced, dropped or followed by another."""
    out = []
    for w in words:
        kind = rng.choice("rda") if rng.random() < rate else ""
        out += [] if kind == "d" else [f"z{rng.randrange(999)}"] if kind == "r" else [w, f"z{rng.randrange(999)}"] if kind == "a" else [w]
    return out


def test_all_pairs_with_a_seed_are_found_and_heavy_edits_keep_one(spark):
    rng = random.Random(6)
    items = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(12, 40))] for _ in range(8)]
    docs = []
    for i in range(160):
        body = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(5, 60))]
        copy = edited(rng, items[i % 8], (0.0, 0.1, 0.2, 0.3)[i // 8 % 4])
        cut = rng.randrange(len(body))
        docs.append((i, body[:cut] + copy + body[cut:] if i % 5 else body))
    hashed = lambda words: np.array([tb.hash_bytes(w.encode()) for w in words], np.uint64)
    item_hashes = [hashed(w) for w in items]
    want = {}
    for i, words in docs:
        d = hashed(words)
        for j, item in enumerate(item_hashes):
            s = decontaminate.similarity(item, d)[0]
            if s >= 0.5:
                seeds = {tuple(items[j][k : k + 3]) for k in range(len(items[j]) - 2)}
                want[i, j] = (s, any(tuple(words[k : k + 3]) in seeds for k in range(len(words) - 2)))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(table, bench).collect()}
    assert set(got) <= set(want)
    assert all(abs(got[k] - s) < 1e-9 for k, (s, seed) in want.items() if seed)
    assert len(want) > 90 and len(got) >= 0.98 * len(want)

"""Collocations against plain counting, however candidates and codes are dealt."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import phrases  # noqa: E402

SCHEMA = "lang string, text string, n int, path string"


def plain(rows, least, words, percent, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, words + 1):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {p: n for p, n in c.items() if n >= least and len(p) > 1}
        absorbed = {p[i:j] for p, n in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * n >= percent * c[p[i:j]]}
        found = []
        for p, a in often.items():
            cut = min(((1000 * a * totals[lang]) // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if p not in absorbed:
                found.append((-cut[0], -a, " ".join(p).encode(), c[p[: cut[1]]], c[p[cut[1] :]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Über", "x-y", "É"]
    fixed = [[rng.choice(words) for _ in range(rng.randrange(2, 8))] for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(12)):
            parts += rng.choice(fixed) if rng.random() < 0.6 else [rng.choice(words)]
            parts[-1:] = [parts[-1] + rng.choice(["", "", "", ".", ",", "\n", "!?"])] if parts else []
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "\t ", "  "]).join(parts)))
    return [*rows, ("en", None), (None, ""), ("fr", " . ;"), ("en", "w1 w2 " * 200), ("de", "W1 w2 " * 50 + "ab" * 300)]


def table(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "p") for lang, text in rows], SCHEMA)


@pytest.mark.parametrize(("least", "percent", "top", "block", "codes"), [(6, 100, 2000, 1 << 17, 1 << 20), (3, 80, 15, 40, 1 << 20), (6, 100, 2000, 25, 10)])
def test_phrases_equal_plain_counting(spark, monkeypatch, least, percent, top, block, codes):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "CODES", codes)
    rows = corpus(least)
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, rows), least, 5, percent, top).collect())
    assert got == plain(rows, least, 5, percent, top) and len(got) > 20


def test_exact_scores_beyond_64_bits(spark):
    big = spark.sql("select cast(3000000000000 as bigint) a, cast(9000000000000000 as bigint) n, cast(3000000000001 as bigint) l, cast(3000000000007 as bigint) r")
    score = big.selectExpr("(cast(cast(a as decimal(20,0)) * 1000 as decimal(38,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(20,0)) * cast(r as decimal(20,0))) as s").first().s
    assert score == 1000 * 3000000000000 * 9000000000000000 // (3000000000001 * 3000000000007)


def test_without_frequent_phrases(spark):
    for rows in ([], [("en", None)], [("en", "a b c d")], [("en", "a. " * 50)]):
        assert phrases.collocations(table(spark, rows), 5).count() == 0
    with pytest.raises(ValueError, match="words"):
        phrases.count_phrases(table(spark, []), 5, 17)


@pytest.mark.parametrize(("top", "depth", "n"), [(3, 4, 50), (200, 2, 3000), (70_000, 3, 4000), (20_000_000, 2, 500)])
def test_tries_find_their_paths(top, depth, n):
    rng = np.random.default_rng(top)
    paths = np.unique(np.minimum(rng.zipf(1.2, (n, depth)), top).astype(np.int32), axis=0)
    rng.shuffle(paths)
    trie = phrases.Trie(paths)
    cells = np.concatenate([np.minimum(rng.zipf(1.2, 5000), top + 3) - rng.integers(0, 2, 5000), np.zeros(8, int)]).astype(np.int32)
    at, leaf = trie.walk(cells, 5000)
    place = {tuple(p): i for i, p in enumerate(trie.paths.tolist())}
    assert sorted(place) == sorted(map(tuple, paths.tolist()))
    assert list(zip(at.tolist(), leaf.tolist(), strict=True)) == [(i, place[w]) for i in range(5000) if (w := tuple(cells[i : i + depth].tolist())) in place]


def test_a_position_is_walked_in_one_trie(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 64)
    paths = [[a, b] for a in range(1, 41) for b in range(1, 9)]
    tries = list(phrases._tries(spark.createDataFrame([(p,) for p in paths], "path array<int>"), 2))
    begins = [set(t.paths[:, 0].tolist()) for t in tries]
    assert len(tries) > 4 and sum(map(len, begins)) == 40
    assert sorted(p for t in tries for p in t.paths.tolist()) == paths
    cells = np.array([39, 3, 0, 7, 50, 7, 1] + [0] * phrases.AHEAD, np.int32)
    met = [(t.walk(cells, 7)[0].tolist(), t.paths[t.walk(cells, 7)[1]].tolist()) for t in tries]
    assert sorted(x for x in met if x[0]) == sorted(([i], [cells[i : i + 2].tolist()]) for i in (0, 5))
    # a word with more paths than a trie holds is dealt by more words
    paths = [[5, b] for b in range(1, 200)]
    tries = list(phrases._tries(spark.createDataFrame([(p,) for p in paths], "path array<int>"), 2))
    assert sorted(p for t in tries for p in t.paths.tolist()) == paths and max(len(t.paths) for t in tries) <= 64

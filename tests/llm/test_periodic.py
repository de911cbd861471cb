"""Runs of words against a direct search, and the query's checksums against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import periodic  # noqa: E402
from quarryline.llm import textbytes as tb  # noqa: E402


def direct(words, shortest=24):
    """All runs by comparing at every distance."""
    ids = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    seen = {}
    for p in range(1, len(a) // 3 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], a[p:] == a[:-p], [0]])))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i >= 2 * p:
                seen.setdefault((i, j + p), p)
    return sorted((s, e - s, p) for (s, e), p in seen.items() if e - s >= shortest)


def stretches(rng):
    kinds = rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(kinds) for _ in range(rng.randrange(260))]
    for _ in range(rng.randrange(5)):
        unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.4:  # periodic but for its last word
            q = rng.randrange(1, 5)
            unit = [unit[i % q] for i in range(len(unit))][:-1] + [99]
        at = rng.randrange(len(words) + 1)
        words[at:at] = [unit[i % len(unit)] for i in range(int(len(unit) * rng.uniform(2.8, 6)))]
    return words


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_of_many_rows(seed):
    rng = random.Random(seed)
    rows = [stretches(rng) for _ in range(30)] + [[], [1], thue_morse(5000), thue_morse(70) * 5, [1] * 700, [1, 2, 3] * 200]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    ids = tb.mix(np.array([w for r in rows for w in r], np.uint64) + np.uint64(7))
    got = [(int(a), int(b - a), int(q)) for a, b, q in zip(*periodic.word_runs(ids, first), strict=True)]
    assert got == [(int(f) + s, n, p) for r, f in zip(rows, first[:-1], strict=True) for s, n, p in direct(r, 0)]


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = direct(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_the_query_equals_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, "  ".join(f"w{x}" for x in stretches(rng))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a " * 23), (1004, "A a " * 30), (1005, "é é\x0bx " * 30), (None, "b " * 40), (7, "b " * 40), (7, "b " * 40), (1006, "q" * 3000 + " z"), (1007, " ".join([*"abcab"] * 9000))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string")
    got = periodic.runs_digest(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digest(i, t) for i, t in rows), key=repr)
    assert periodic.runs_digest(docs.where("false")).count() == 0


def test_runs_and_collapsed_text(spark):
    text = "start " + "la di da " * 10 + "end\nof it"
    row = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id int, text string"), 9).first()
    assert [tuple(r) for r in row.runs] == [(1, 30, 3)] and row.collapsed == "start la di da end of it" and row.n_words == 34

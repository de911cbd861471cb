"""Sketches, their likelihoods, and whole joins against exact sets."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import setsketch as sk  # noqa: E402
from quarryline.llm import textbytes as tb  # noqa: E402


def pair(rng, size, jaccard):
    both = round(size * jaccard)
    ids = tb.mix(np.arange(2 * size - both, dtype=np.uint64) + rng.integers(1, 1 << 60, dtype=np.uint64))
    return ids[:size], ids[size - both :] if both else ids[size:]


def test_sketches_of_parts_merge():
    ids = tb.mix(np.arange(1, 500, dtype=np.uint64))
    a, b, whole = sk.sketches([ids[:300], ids[200:], ids])
    assert (sk.merged(a, b) == whole).all() and (sk.sketches([ids[:0]]) == 0).all() and whole.min() > 0 and whole.max() < 255


@pytest.mark.parametrize("size", [8, 60, 1000])
def test_likelihoods_estimate_jointly(size):
    rng = np.random.default_rng(size)
    for both in (0.5, 0.85, 0.97):
        pairs = [pair(rng, size, both) for _ in range(60)]
        x, y = sk.sketches([p[0] for p in pairs]), sk.sketches([p[1] for p in pairs])
        exact = np.array([len(np.intersect1d(*p)) / len(np.union1d(*p)) for p in pairs])
        n = np.full(60, float(size))
        more, same = (x > y).sum(axis=1), (x == y).sum(axis=1)
        best = sk.GRID[sk.likelihoods(more, sk.REGISTERS - more - same, same, n, n).argmax(axis=1)]
        assert abs((best - np.maximum(exact, sk.GRID[0])).mean()) < 0.02
        keep, _ = sk.candidates(x, y, n, n)
        assert keep[exact >= 0.85].all() and not keep[exact < 0.6].any()


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        x, y = sk.sketches(list(pair(rng, 200, 2 * 0.85 / 1.85)))
        met += bool((x == y).reshape(-1, sk.BAND).all(axis=1).any())
    assert met == 300


def exact_groups(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_whole_joins_equal_exact_sets(spark):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.choice([4, 9, 40, 150, 400]))]
        rows += [(None, " ".join(base))] + [(len(rows) + k, rng.choice([" ", "\n"]).join(edited(rng, base, rng.randrange(0, max(1, len(base) // 14))))) for k in range(14)]
    # a hub whose copies link with it alone
    hub = [f"h{rng.randrange(500)}" for _ in range(300)]
    rows += [(5000, " ".join(hub))] + [(5001 + k, " ".join(edited(rng, hub, 7))) for k in range(60)]
    rows += [(6000, None), (6001, ""), (6002, " \t"), (6003, "one"), (6004, "ONE"), (6005, "a b"), (6006, "a b c"), (None, "only null"), (None, None), (6007, "x" * 50_000), (6010, " ".join(f"v{i}" for i in range(40_000))), (6011, " ".join(f"v{i}" for i in range(39_000)))]
    rows += [(7, rows[3][1]), (7, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 3, "b") for i, t in rows], "doc_id long, text string, node int, component string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in sk.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(exact_groups(rows), key=repr)
    kept = sk.deduplicated(docs)
    assert kept.columns == docs.columns
    flags = sk.dedup_digest(docs).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in flags if r.doc_id is not None)
    assert {r.doc_id for r in flags if r.kept} == {r.doc_id for r in kept.collect()}


def test_empty_and_single_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sk.dedup_digest(none).count() == 0 and sk.deduplicated(none).count() == 0
    assert [tuple(r) for r in sk.dedup_digest(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).collect()] == [(3, 2, 3, True)]

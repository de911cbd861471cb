"""Each operator on small messy tables, against brute force where SQL can't say it."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quarryline.llm")

from quarryline.llm import chat, decontaminate, hmm_lm, html_extract, mixing, ngram_join, quality, sharding, topk, toxicity  # noqa: E402
from quarryline.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: extra columns whose names clash with those that operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, shard int, rh long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, 2.0, 3, 4) for i, t, lang, s in rows], SCHEMA)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def messy():
    """Copies, near copies, nulls, empty, blank, short and long texts, repeated rows."""
    base = prose(1, 300)
    rows = [(1, base, "en", "a"), (2, base, "de", "a"), (3, base.replace("w5 ", "zz "), "en", None), (4, base.upper(), "en", "b"), (5, None, "en", "a"), (6, "", None, "a"), (7, " \t\n", "en", "b"), (8, "one two", "en", "b"), (9, "ONE  two", "en", "b"), (10, "x", "fr", "a")]
    rows += [(11, prose(2, 9000), "en", "a"), (12, prose(3, 300), "en", "a"), (12, prose(3, 300), "en", "a")]
    for i in range(20, 50):
        text = prose(100 + i // 3, 30 + i // 3 * 2).split()
        text[i % 3 * 7] = f"edit{i}"
        rows.append((i, " ".join(text), "en", "abc"[i % 3]))
    return rows


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [(1, "x", "en", "a")]).where("doc_id < 0")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_set_join_equals_brute_force(spark, messy, nothing):
    docs = table(spark, messy)
    got = ngram_join.join_components(docs)
    assert got.count() == len(messy)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(messy)
    kept = sorted(r.doc_id for r in ngram_join.one_of_each_group(docs).collect())
    want = brute_components(messy)
    assert kept == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)
    assert ngram_join.one_of_each_group(docs).columns == docs.columns
    assert ngram_join.join_components(nothing).count() == 0


def test_set_join_threshold_is_exact(spark):
    rows = []
    for k in range(8):
        for n in (6, 11, 25, 44):
            words = [f"t{k}_{n}_{j}" for j in range(n + 4)]
            rows.append((1000 * k + 2 * n, " ".join(words), "en", "a"))
            rows.append((1000 * k + 2 * n + 1, " ".join(words[: len(words) - k]), "en", "a"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_sharding(spark, messy, nothing):
    rows = messy + [(100 + i, prose(i, 40), "en", "hot") for i in range(300)] + [(900 + i, "the same text again", "en", "hot") for i in range(200)]
    got = sharding.kd_shards(table(spark, rows), shards=5).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(5))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = got.groupby("shard")["size"].sum()
    largest = max(len((t or "").encode()) for _, t, *_ in rows) + 16
    assert sizes.max() - sizes.min() <= 2 * largest
    text = {i: t for i, t, *_ in rows}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.size == len((text[r.doc_id] or "").encode()) + 16 for r in got.itertuples())
    assert got[got.doc_id.isin([1, 2])]["shard"].nunique() == 1
    assert sharding.kd_shards(nothing, shards=3).count() == 0
    assert sharding.shard_digest(table(spark, messy)).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_one_period_is_fair():
    parts = mixing.shares({"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}, 100)
    period, done = sum(parts.values()), Counter()
    for t, (source, k, slot) in enumerate(mixing.one_period(parts), 1):
        assert slot == t - 1 and k == done[source]
        done[source] += 1
        assert all(abs(done[s] - a * t / period) < 1 for s, a in parts.items())
    assert done == Counter(parts)


def test_mixing(spark, messy, nothing):
    rows = [(i, prose(i, 30), "en", "ab"[i % 3 == 0]) for i in range(400)] + messy
    docs = table(spark, rows)
    weights = {"a": 0.6, "b": 0.2, "c": 0.1, None: 0.1}
    got = mixing.scheduled(docs, weights, 1000, 100).toPandas()
    assert len(got) == len(rows)
    parts = mixing.shares(weights, 100)
    slots = got.groupby([got.source.fillna("-"), "mix_block"]).mix_slot.agg(["min", "max"]).reset_index()
    assert (slots["min"] == slots["max"]).all() and slots["min"].is_unique
    for s, g in slots.groupby("source"):
        a = parts[None if s == "-" else s]
        for b, slot in zip(g.mix_block, g["min"], strict=True):
            assert b * 100 // a <= slot < -(-(b + 1) * 100 // a)
    assert mixing.mixed(docs, weights, 1000).count() == len(rows)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.scheduled(docs, {"a": 1.0}).count()


def test_decoder(spark):
    text = " ".join(["idiot worthless stupid loser moron pathetic the and of with that this from"] * 30)
    decode = toxicity.Decoder(toxicity.language_model(table(spark, [(1, text, "en", "a")])))
    for written, meant in (("id1ot", "idiot"), ("m0r0n", "moron"), ("st-u-p-i-d", "stupid"), ("l.0.s.e.r", "loser"), ("idiiiot", "idiot"), ("worthless", "worthless"), ("stupid", "stupid")):
        assert decode(written) == meant


def test_toxicity(spark, nothing):
    rng = random.Random(5)
    bad = ["idiot", "scum", "moron"]
    disguised = ["id1ot", "s c u m", "m0r0n", "iiidiot"]
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 40).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad if i % 8 else disguised))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (None, "idiot idiot scum", "en", "a"), (1002, prose(7, 30000), "en", "a")]
    labels += [(0, None, 0), (None, 1, 1), (5, 1, 7), (3, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(table(spark, rows), labels).toPandas()
    assert len(got) == len(rows)
    seen = got[got.doc_id < 400]
    right = (seen.predicted == (seen.doc_id % 4 == 0)).mean()
    assert right > 0.97
    assert ((seen.doc_id.astype(int).astype(str).map(lambda s: zlib.crc32(s.encode()) % 4 == 2)) == seen.held_out).all()
    assert got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()
    assert got[got.doc_id.isin([1000, 1001, 1002])].predicted.sum() == 0
    assert toxicity.score(nothing, labels).count() == 0
    assert toxicity.score(table(spark, rows[:9]), labels.where("doc_id < 0")).count() == 9


def test_quality(spark, nothing):
    rows, labels = [], []
    for i in range(300):
        text = prose(i, 50)
        if i % 3 == 0:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w + " " + w for w in text.split())][i // 3 % 3]
        rows.append((i, text, "en", "a"))
        labels.append((i, int(i % 3 != 0), 0))
    rows += [(1000, None, "en", "a"), (1001, " ", "en", "a"), (None, "x", "en", "a"), (1002, prose(7, 30000), "en", "a"), (1002, prose(7, 30000), "en", "a")]
    labels = spark.createDataFrame(labels + [(1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(table(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[(got.doc_id < 300) & got.held_out]
    assert (held.predicted == (held.doc_id % 3 != 0)).mean() > 0.95
    assert quality.score(nothing, labels).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.3, (300, 6)).round(2))]
    vectors += [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(60)]
    odd = [(2000, None), (2050, [1.0, None, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf"), 0.0]), (2200, [0.5]), (2250, []), (None, [1.0] * 6), (3, vectors[3][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.topk_digest(df).collect())
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors + odd[4:6] + odd[7:]]
    want = []
    for q, a in {i: v for i, v in clean if i % 50 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q)
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert got == sorted(want)
    assert topk.topk_digest(df.where("vec_id < 0")).count() == 0


def test_chat(spark):
    d = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    a = [("user", "hi"), ("assistant", "yes"), ("user", None)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(a)] + [(2, k, r, t) for k, (r, t) in enumerate(a[:2])] + [(3, 5 + k, r, t) for k, (r, t) in enumerate(a)]
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "no"), (4, 1, "assistant", "no"), (None, 0, "user", "x"), (5, None, "user", "odd")]
    rows += [(6, k, "user", f"t{k % 3}") for k in range(600)] + [(7, k, "user", f"t{k % 3}") for k in range(599)]
    got = {(r.conv_id, r.part): r for r in chat.render(d(rows), part_bytes=4000).collect()}
    assert {k[0] for k in got} == {1, 4, 5, 6} and {k[1] for k in got if k[0] == 6} == {0, 1, 2}
    assert got[1, 0].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n"
    assert got[1, 0].n_copies == 2 and got[4, 0].n_turns == 2
    whole = "".join(got[6, p].rendered for p in range(3))
    assert whole == "".join(f"<|user|>\nt{k % 3}<|end|>\n" for k in range(600))
    assert chat.render(d(rows).where("conv_id < 0")).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_alignment_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))], np.uint64)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 20))], np.uint64)
        assert abs(decontaminate.similarity(a, b)[0] - smith_waterman(a.tolist(), b.tolist())) < 1e-9


def test_decontamination(spark, nothing):
    item = prose(50, 30, 5000)
    edited = item.split()
    edited[5], edited[17] = "other", "words"
    del edited[11]
    clean = [(i, prose(i, 200, 5000), "en", "a") for i in range(1, 30)]
    hot = [(200 + i, prose(i, 20, 5000) + " " + item, "en", "a") for i in range(40)]
    rows = clean + hot + [(100, prose(60, 80, 5000) + " " + item.upper().replace(" ", ", ") + " end", "en", "a"), (101, prose(61, 9, 5000) + " " + " ".join(edited), "en", "a"), (102, None, "en", "a"), (103, "", "en", "a"), (104, "tiny thing", "en", "a"), (101, prose(61, 9, 5000) + " " + " ".join(edited), "en", "a")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, prose(51, 25, 5000)), (3, None), (4, ""), (5, "tiny thing")], "item_id long, text string")
    docs = table(spark, rows)
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100, 1), (101, 1), (104, 5), *((i, 1) for i, *_ in hot)}
    assert len(got) == 4 + len(hot) and all(r.similarity >= 0.5 for r in got)
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i, *_ in clean] + [102, 103])
    assert decontaminate.find_leaks(nothing, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("item_id < 0")).count() == 0


def test_minimum_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(80):
        n = rng.randrange(1, 8)
        lean = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda keep: sum(max(0, -x) if k else max(0, x) for x, k in zip(lean, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.minimum_cut(lean, edges)) - best) < 1e-9


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
    <header><a href="/">Home</a></header><nav><ul><li><a href=a>A</a></li></ul></nav><div class="cookie-banner">We use cookies</div>
    <article><h1>Big &amp; small</h1><p>First <b>bold</b>  text<br>here &eacute;.<p>Second one.<!-- <p>hidden</p> --></p><div class="share-buttons">Share</div><section id="comments"><p>Great post!</p></section></article>
    <aside>Aside</aside><form><label>Mail</label></form><div class="ad">Buy</div><footer>&copy; us</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page, 9), (2, None, None, 9), (3, "v", "", 9), (4, "w", "<p>unclosed <b>text of a page that goes on", 9), (5, "x", "<nav>only a menu", 9), (1, "u", page, 9)], "page_id long, url string, html string, text int")
    got = html_extract.extract(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 6 and text[1] == "Big & small\nFirst bold text here é.\nSecond one."
    assert text[2] == text[3] == text[5] == "" and text[4] == "unclosed text of a page that goes on"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages.where("page_id > 9")).count() == 0


@pytest.mark.parametrize("sent", [3, 1 << 20])
def test_language_model(spark, messy, nothing, monkeypatch, sent):
    monkeypatch.setattr(hmm_lm, "SENT", sent)
    got = hmm_lm.score(table(spark, messy), passes=1).toPandas()
    assert len(got) == len(messy)
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t, *_ in messy}
    c = Counter()
    for i, *_ in messy:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens[i])
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        t = tokens[r.doc_id]
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) < 1e-6 * max(1, abs(r.base_score))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n) and r.score <= 0
    assert hmm_lm.score(nothing).count() == 0

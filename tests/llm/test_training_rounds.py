"""Baum-Welch: every pass takes all training texts, in tasks; recursions are exact."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import hmm_lm  # noqa: E402
from quarryline.llm import textbytes as tb  # noqa: E402


def corpus(spark, n=120):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("the a one", "runs sits eats", "cat dog bird tree")[k % 3].split()) for k in range(rng.randrange(1, 40)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, rows[0][1]), (n + 3, "The cat " * 3000)], "doc_id long, text string"), rows


def test_the_driver_trains_on_no_texts(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(hmm_lm.Chain, "expect", refuse)
    docs, rows = corpus(spark)
    assert hmm_lm.score(docs, passes=1).count() == len(rows) + 4


def test_likelihood_grows_and_passes_end(spark):
    model = hmm_lm.LanguageModel(corpus(spark)[0], passes=40)
    gains = np.diff(model.likelihoods)
    assert 2 < len(model.likelihoods) < 40 and (gains > -1e-6).all() and gains[-1] < hmm_lm.GAIN * abs(model.likelihoods[-1])
    untrained = hmm_lm.Chain.guess(model.mass)
    texts = [np.array([1, 2, 3, 0])]
    assert hmm_lm.Pieces(model.chain, texts).log10(model.chain)[0] > hmm_lm.Pieces(untrained, texts).log10(untrained)[0]


def plain_forward(chain, text):
    a = chain.first * chain.emit[text[0]]
    for x in text[1:]:
        a = (a @ chain.move) * chain.emit[x]
    return math.log10(a.sum())


def plain_counts(chain, text):
    k = hmm_lm.STATES
    alphas = [chain.first * chain.emit[text[0]]]
    for x in text[1:]:
        alphas.append((alphas[-1] @ chain.move) * chain.emit[x])
    betas = [np.ones(k)]
    for x in text[:0:-1]:
        betas.append(chain.move @ (chain.emit[x] * betas[-1]))
    betas.reverse()
    p = alphas[-1].sum()
    moves, emit = np.zeros((k, k)), np.zeros((hmm_lm.CLASSES, k))
    for i, x in enumerate(text):
        emit[x] += alphas[i] * betas[i] / p
        if i:
            moves += alphas[i - 1][:, None] * chain.move * (chain.emit[x] * betas[i]) / p
    return np.concatenate([alphas[0] * betas[0] / p, moves.ravel(), emit.ravel()])


@pytest.mark.parametrize("piece", [2048, 3, 1])
def test_recursions_over_pieces_equal_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(hmm_lm, "PIECE", piece)
    rng = np.random.default_rng(2)
    chain = hmm_lm.Chain.guess(rng.integers(1, 50, hmm_lm.CLASSES).astype(float))
    texts = [rng.integers(0, 20, n) for n in (5, 3, 1, 9, 6, 2)]
    pieces = hmm_lm.Pieces(chain, texts)
    assert np.allclose(pieces.log10(chain), [plain_forward(chain, t) for t in texts], atol=1e-9)
    counts, told = pieces.expect(chain)
    assert np.allclose(counts, sum(plain_counts(chain, t) for t in texts), atol=1e-4)
    assert abs(told - sum(plain_forward(chain, t) for t in texts)) < 1e-3


def test_scores_equal_a_plain_recursion(spark):
    docs, _ = corpus(spark)
    model = hmm_lm.LanguageModel(docs, passes=2)
    got = {r.doc_id: r.score for r in hmm_lm.score(docs, passes=2).collect()}
    own = dict(zip(model.counts.hashes.tolist(), model.counts.own.tolist(), strict=True))
    count = dict(zip(model.counts.hashes.tolist(), model.counts.counts.tolist(), strict=True))
    for r in docs.collect():
        classes, share = [], 0.0
        for word in (r.text or "").lower().encode().split():
            h = tb.hash_bytes(word)
            c = own.get(h, 0) or tb.hash_bytes(word[-3:]) % hmm_lm.ENDINGS + 1 + hmm_lm.OWN
            if c > hmm_lm.OWN:
                share += math.log10((count.get(h, 0) + 1) / (model.sums[c] + 1))
            classes.append(c)
        alpha, told = None, 0.0
        for c in [*classes, 0]:
            alpha = model.chain.emit[c] * (model.chain.first if alpha is None else alpha @ model.chain.move)
            told += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert abs(got[r.doc_id] - told - share) < 1e-6 * max(1, abs(told))

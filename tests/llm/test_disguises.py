"""Heavily disguised words reach the decoder and come back as what they mean."""

import numpy as np
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import toxicity  # noqa: E402


@pytest.fixture(scope="module")
def decode(spark):
    text = " ".join(["idiot worthless stupid loser moron pathetic you are an trash the and of with that this from"] * 30)
    return toxicity.Decoder(toxicity.language_model(spark.createDataFrame([(1, text)], "doc_id long, text string")))


def restored(decode, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return " ".join(decode(t) for _, t in toxicity._disguised(data, np.array([0, len(data)]))).split()


@pytest.mark.parametrize(
    "written, meant",
    [
        ("1d10t", "idiot"), ("7r45h", "trash"), ("s.t.u.p.1.d", "stupid"), ("s--t--u--p--i--d", "stupid"),  # mostly signs
        ("l053r", "loser"), ("(tr45h)", "trash"), ("stup1d!!", "stupid"), ("!d10t,", "idiot"), ("idi07", "idiot"),  # three signs, signs at the ends
        ("iiiiiiiiiiiiiiiiddddddddddddddddioooooooooooooooot", "idiot"), ("s----------t----------u----------p----------i----------d", "stupid"),  # long
    ],
)
def test_every_disguise_is_decoded(decode, written, meant):
    assert restored(decode, f"the {written} of") == [meant]


def test_spaced_words_end_between_letters(decode):
    assert restored(decode, "that y o u i d i o t from") == ["you", "idiot"]
    assert restored(decode, "s t u p i d with") == ["stupid"]


def test_long_spelled_out_sentence_is_decoded(decode):
    found = restored(decode, " ".join("youareanidiotandthatstupidloserwiththismoronfromthepathetictrash"))
    assert {"idiot", "stupid", "loser", "moron", "pathetic", "trash"} <= set(found)


def test_plain_words_are_not_decoded(decode):
    assert restored(decode, 'this, "that" (of) the. and: 1234') == []


def every_reading(model, word):
    """(cost, text) of all readings of a word, one by one, without merging any."""
    number = lambda y: ord(y) - 96 if "a" <= y <= "z" else 27 + ord(y) % 32

    def go(i, a, b, last, cost, text):
        if i == len(word):
            yield cost - (model[a][b][0] if b else 0), text
            return
        x = word[i]
        signs = toxicity.LOOKS_LIKE.get(x, "")
        for y, extra in [(x, 0.0)] if x.isalpha() else [(y, toxicity.SUBSTITUTED) for y in signs]:
            yield from go(i + 1, b, number(y), y, cost + extra - model[a][b][number(y)], text + y)
        if x == last or not x.isalpha() and last in signs:
            yield from go(i + 1, a, b, last, cost + (toxicity.REPEATED if word[max(0, i - 2) : i + 3].count(x) > 2 else toxicity.DOUBLED), text)
        if x == " ":
            yield from go(i + 1, a, b, last, cost + toxicity.SEPARATED, text)
            if b:
                yield from go(i + 1, 0, 0, "", cost + toxicity.SEPARATED - model[a][b][0], text + " ")
        elif not x.isalpha():
            if x in toxicity.SEPARATORS:
                yield from go(i + 1, a, b, last, cost + toxicity.SEPARATED, text)
            yield from go(i + 1, 0, 0, "", cost + toxicity.KEPT_SIGN - (model[a][b][0] if b else 0), text + " " * bool(b))

    return list(go(0, 0, 0, "", 0.0, ""))


@pytest.mark.parametrize("word", ["1d10t", "s.t.u.p", "a$$", "l00ser", "t r 4 5 h", "m0-r0n", "||l1", "iidd", "yo u", "5tu!d", "---", "7h3 a"])
def test_viterbi_finds_the_best_of_all_readings(decode, word):
    readings = every_reading(decode.model, word)
    best = min(cost for cost, _ in readings)
    assert decode(word) in {text for cost, text in readings if cost <= best + 1e-9}


@pytest.mark.parametrize("word, want", [("д у р а к", "дурак"), ("ü b e l", "übel")])
def test_spaced_letters_of_any_script_are_joined(spark, word, want):
    model = toxicity.language_model(spark.createDataFrame([(1, f"{want} и не но das ist " * 50)], "doc_id long, text string"))
    assert want in restored(toxicity.Decoder(model), f"und {word} und")

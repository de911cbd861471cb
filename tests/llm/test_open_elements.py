"""Pages that leave out end tags keep their article."""

import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm.html_extract import main_text  # noqa: E402

BODY = "<h1>Big news today</h1><p>The first paragraph of the article is long enough to be text.<p>So is the second paragraph of it, by all means."
TEXT = "Big news today\nThe first paragraph of the article is long enough to be text.\nSo is the second paragraph of it, by all means."


@pytest.mark.parametrize("page", [f"<html><head><title>T</title><meta charset=utf-8>{BODY}", f"<head><title>T{BODY}", f"<html><head><title>T</title><body>{BODY}", f"<title>T</title>{BODY}"])
def test_head_ends_at_the_first_element_that_it_cannot_hold(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("open_tag", ["<button>Menu", "<svg><path d='m0'>", "<select><option>One", "<object>no", "<video>no", "<iframe>no"])
def test_an_element_that_is_not_closed_ends_with_what_holds_it(open_tag):
    assert main_text(f"<body><header><a href=/>Home</a>{open_tag}</header>{BODY}</body>") == TEXT
    assert main_text(f"<body><header>{open_tag}</header>{BODY}<button>Share</button></body>") == TEXT


def test_dropped_elements_go_whole_and_formulas_stay():
    assert main_text("<article><p>Here <button><div>Share</div></button> and there <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><svg><text>no</text></svg><p>More of it.</p></article>") == "Here and there x=2 hold.\nMore of it."
    assert main_text("<p>One sentence of the page that is long enough.<script>var a = '<p>no</p>'") == "One sentence of the page that is long enough."

"""Phased plans: each layout, which one counts, and texts that have none."""

import pytest

from quarryline.functions import phases as ph
from quarryline.operators import planning as pl


@pytest.mark.parametrize(
    ("line", "want"),
    [("Phase 1", (1, "")), ("release - 12: x", (12, ": x")), ("PHASE–3", (3, "")), ("Phase -- 2", None), ("Phases 2", None), ("Phase one", None), ("my Phase 1", None), ("Phase", None), ("", None)],
)
def test_numbered(line, want):
    assert ph.numbered(line, ph.PHASE_WORDS) == want
    if line == "Phase -- 2":
        assert ph.numbered(line, ph.PHASE_WORDS, 2) == (2, "")


def test_headings_need_a_line_of_their_own():
    text = "intro\nPhase 1 is early\n## Phase 1: Core\n- one thing\n- ok\n2. second\n######## Phase 8\n### Phase 2 —\nRelease 2 — More\nUC#3, UC 4 and uc5\n- unseen\n"
    assert ph.plan(text) == ("heading", [("Phase 1: Core", ["one thing", "second"]), ("Phase 2: More", ["UC#3", "UC#4", "UC#5"])], None)


def test_tables():
    bars = "notes | here\n| ID | Name | Phase/Release |\n|:--|---|\n| 1 | a | Phase - - 2 |\n\n|  | b | Release 1 |\n| 3 | c | soon |\n| 4 |\n"
    # an empty cell moves the ones behind it, so that row has no phase in its column
    assert ph.tabled(bars.splitlines()) == [("Phase 2", ["1"])]
    tabs = "Feature\tPhase\nlogin\tPhase 2\npay\tphase 1\nship\tPhase 2"
    assert ph.plan(tabs) == ("table", [("Phase 1", ["pay"]), ("Phase 2", ["login", "ship"])], None)
    wide = "Owner   Release\nme   Release 1\nyou   Release 10\n"
    assert ph.plan(wide) == ("table", [("Phase 1", ["me"]), ("Phase 10", ["you"])], None)
    assert ph.tabled(["a b c", "no table"]) == []


def test_line_ends_need_three_rows():
    rows = ["login of users Phase -1", "UC 7 pays   Release - 2", "x" * 80 + " phase 1"]
    assert ph.plan("\n".join(rows)) == ("line end", [("Phase 1", ["login of users", "x" * 60]), ("Phase 2", ["UC#7"])], None)
    assert ph.plan("\n".join(rows[:2])) == (None, [], None)


def test_marks():
    text = "see UC#12 [Phase 2], Pay_now [Sprint 1 - 3] (x) [Phase 1] [Release 2] ÄOrder [release-2] Late [Phase 3 of 4] [Phase"
    assert ph.marked(text) == [("Phase 1", ["Pay_now"]), ("Phase 2", ["UC#12", "Order"])]


def test_milestones_and_single_phases():
    assert ph.plan("Milestone 1 - A\n- first\nMilestone 2: B\nMilestone 3\n") == ("milestone", [("Milestone 1 - A", ["first"]), ("Milestone 2 - B", [])], None)
    assert ph.plan("## Phase 1: all\n- everything") == (None, [], None)
    for none in (None, "", " \n\t", "phase", "[", "Phase 99999999999999999999"):
        assert ph.plan(none)[1:] == ([], None)


def test_layouts_that_disagree_are_told(spark):
    docs = spark.createDataFrame([(1, "Phase 1\nPhase 2\nA [Phase 1] B [Phase 2] C [Phase 3]"), (2, "Phase 1\nPhase 2\nA [Phase 1] B [Phase 5]"), (3, None), (None, "Release 1\nRelease 2")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.layout or "", r.ordinal, r.name or "", r.warning) for r in pl.phase_plan(docs).collect()))
    assert got == [(0, "heading", 1, "Phase 1", None), (0, "heading", 2, "Phase 2", None), (1, "", 0, "", ph.CONFLICT), (2, "heading", 1, "Phase 1", None), (2, "heading", 2, "Phase 2", None)]
    assert pl.phase_plan(docs.where("false")).count() == 0

"""Documents of services: front matter, sections, schemas within a budget."""

from quarryline.functions import service_docs as sd
from quarryline.operators import ingest as ig

TABLE = "| Field | Type |\n|---|---|\n"
SCHEMAS = {"A": TABLE + "| x | B[] |", "B": TABLE + "| y | List<C> |\n| z | C |", "C": TABLE + "| back | A |", "D": TABLE + "| q | int |"}


def test_schemas_that_schemas_name():
    block = "### GET /a\nResponse `200`: `A`\nResponse `404`: `Missing`"
    assert sd.needed(block, SCHEMAS) == ["A", "B", "C"]
    assert sd.needed("Request body: `A`\n\n| Field | Type |\n|---|---|\n| x | B |", SCHEMAS) == ["B", "C"]
    assert sd.needed("Response: `D`\nRequest body `D`", SCHEMAS) == []
    whole = sd.with_schemas(block, SCHEMAS, 10_000)
    assert whole == block + "".join(f"\n\n#### Schema {n}\n{SCHEMAS[n]}" for n in "ABC")


def test_budgets_hold():
    block = "### GET /a\nResponse `200`: `A`"
    big = {"A": TABLE + "\n".join(f"| f{i} | B |" for i in range(50)), "B": TABLE + "| y | int |"}
    whole = sd.with_schemas(block, big, 5000)
    for most in range(len(block) + 80, 900, 7):
        out = sd.with_schemas(block, big, most)
        assert len(out) <= most and out.startswith(block) and (out == whole or "\nFull schema: " in out)
        assert out == whole or most < len(whole) + 70
        if "#### Schema A" in out:
            assert "| f0 |" in out
    assert "Full" not in sd.with_schemas(block, big, 5000) and sd.with_schemas(block, {}, 10) == block


def test_front_matter():
    assert sd.front_matter("---\nservice_id: pay\naliases: [a, 'b c']\nbad line\n---\n\nBody\n---\n") == ({"service_id": "pay", "aliases": ["a", "b c"]}, "Body\n---\n")
    assert sd.front_matter("---\nnever ends") == ({}, "---\nnever ends") and sd.front_matter("text") == ({}, "text")


def test_chunks_stay_in_their_section(spark):
    long = "word. " * 300
    text = f"---\nservice_id: pay\ndoc_type: HLD\nsummary: Pays.\n---\n# Pay\nIntro.\n## One\n### a\nshort\n### b\n{long}\n### c\ntail\n## Two\nend"
    got = ig.service_doc_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), 100, 20).orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {1} and [r.chunk_index for r in got] == list(range(len(got)))
    assert got[0].section_title == "Introduction" and got[0].display_text == "[pay | unknown] HLD › Introduction\nPays.\n\nIntro."
    assert got[-1].section_title == "Two" and got[-1].original_segment == "## Two\nend"
    assert all(len(r.original_segment) <= 400 for r in got) and any(r.section_title == "One › b" for r in got)
    assert sum(r.original_segment.count("word.") for r in got) == 300


def test_small_pieces_merge_and_sections_name_three(spark):
    text = "## Endpoints\n" + "\n".join(f"### GET /{i}\nRequest body: `S`" for i in range(5)) + "\n## Schemas\n### S\n" + TABLE + "| a | int |"
    got = ig.service_doc_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert got[0].section_title == "Endpoints › GET /0, GET /1, GET /2 …" and got[0].original_segment.count("#### Schema S") == 5

"""What estimates are made from: phases, sections, templates, systems that belong together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phases as ph
from ..sources.stages import stored

#: texts that stand for one to be written (fixed values)
PLACEHOLDERS = r"(?i)\b(tbd|todo|tbc|to be (?:defined|determined|added|confirmed)|lorem ipsum|xxx+|placeholder)\b"
LEAST_CHARS, NEAR_CHARS, NAME_CHARS = 20, 2000, 40
#: integration items that a request gets at most, and complexity by criticality (fixed values)
MOST_ADDED = 8
COMPLEXITY = {"critical": "complex", "high": "medium", "medium": "simple", "low": "simple"}


_PHASES = "ordinal int, name string, use_cases array<string>"


def _phase_rows(docs: DataFrame, rows: Callable[[str | None], list[tuple]], columns: str) -> DataFrame:
    """(doc_id, columns): the rows that a helper makes of each text."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(doc_id, *row) for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) for row in rows(text)]
            yield pd.DataFrame(out, columns=["doc_id", *names], dtype=object)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {columns}")


def detect_phases(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, name, use_cases): phase and release headings of documents (doc_id,
    text), alone on a line, with their number and title, and what stands below each up to
    the next one: UC numbers, or else list items."""
    return _phase_rows(docs, lambda text: [(i, *p) for i, p in enumerate(ph.headed((text or "").splitlines(), ph.PHASE_WORDS, False), 1)], _PHASES)


def phase_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, layout, warning, ordinal, name, use_cases): the phases of documents (doc_id,
    text) by the first layout that they have: headings, a table with a column of phases, lines
    that end in one, marks in brackets, milestones.  A document whose layouts disagree on the
    number of phases has one row with a warning; one with fewer than two phases has none."""

    def rows(text: str | None) -> list[tuple]:
        layout, phases, warning = ph.plan(text)
        return [(None, warning, 0, None, None)] if warning else [(layout, None, i, *p) for i, p in enumerate(phases, 1)]

    return _phase_rows(docs, rows, f"layout string, warning string, {_PHASES}")


def _base(name):
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), r"\s*\(.*?\)", ""))


def readiness(present: DataFrame, template: DataFrame) -> DataFrame:
    """(doc_id, percent): the weight of a template's sections (section, weight) that a
    document's sections (doc_id, section) have: the same name, one in the other (without
    what stands in brackets), or the same first three words.  A template is small by nature;
    only distinct names meet it."""
    names = present.select(F.col("section").alias("_raw")).distinct().select("_raw", F.lower(F.trim("_raw")).alias("_p"), _base(F.col("_raw")).alias("_pb"))
    t = template.select("section", "weight", F.lower(F.trim("section")).alias("_t"), _base(F.col("section")).alias("_tb"))
    three = lambda c: F.slice(F.filter(F.split(c, r"\s+"), lambda w: w != ""), 1, 3)
    ok = (F.col("_t") == F.col("_p")) | (F.col("_tb") == F.col("_pb")) | F.contains("_p", "_tb") | F.contains("_t", "_pb") | ((F.size(three(F.col("_tb"))) > 0) & (three(F.col("_tb")) == three(F.col("_pb"))))
    met = names.join(F.broadcast(t), ok).select("_raw", "section", "weight")
    got = present.withColumnRenamed("section", "_raw").join(met, "_raw").select("doc_id", "section", "weight").distinct().groupBy("doc_id").agg(F.sum("weight").alias("_w"))
    total = template.agg(F.sum("weight").alias("_all"))
    rows = present.select("doc_id").distinct().join(got, "doc_id", "left").crossJoin(F.broadcast(total))
    return rows.select("doc_id", F.when(F.col("_all") > 0, F.round(100.0 * F.coalesce("_w", F.lit(0.0)) / F.col("_all"), 1)).otherwise(F.lit(0.0)).alias("percent"))


def section_quality(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section, status): what follows a section's name (its first 40 characters,
    without brackets, any case) in a document (doc_id, text), up to the next line that
    looks like a heading or 2000 characters: missing (nothing), placeholder, insufficient
    (under 20 characters) or filled; filled too if the name isn't found.  sections: doc_id,
    section."""
    rows = docs.join(sections, "doc_id")
    base = F.substring(F.trim(F.regexp_replace("section", r"\s*\(.*?\)", "")), 1, NAME_CHARS)
    at = F.expr("locate(lower(_b), lower(text))")
    rows = rows.withColumn("_b", base).withColumn("_at", at)
    near = F.expr(f"substring(text, _at + length(_b), {NEAR_CHARS})")
    rows = rows.withColumn("_near", near)
    body = F.regexp_replace("_near", r"(?s)\n[A-Z0-9][\w\s]{2,50}(\n.*|$)", "")
    bare = F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))
    status = F.when((F.col("_at") == 0) | (F.col("_b") == ""), "filled").when(bare == "", "missing").when(body.rlike(PLACEHOLDERS), "placeholder").when(F.length(bare) < LEAST_CHARS, "insufficient").otherwise("filled")
    return rows.select("doc_id", "section", status.alias("status"))


def template_match(items: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, id, area): the first area (ordinal, area) of a template that an item (doc_id,
    id, name) contains, is contained in, or shares at least half of the long words with (of
    the one that has fewer); null for none.  Only distinct names meet the areas, which are
    few by nature."""
    long = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3))
    names = items.select("name").distinct().select("name", F.lower(F.trim("name")).alias("_n"))
    known = areas.select("ordinal", "area", F.lower(F.trim("area")).alias("_a"))
    a, b = long(F.col("_n")), long(F.col("_a"))
    fuzzy = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) >= F.least(F.size(a), F.size(b)) * 0.5)
    met = names.join(F.broadcast(known), F.contains("_n", "_a") | F.contains("_a", "_n") | fuzzy)
    first = met.groupBy("name").agg(F.min_by("area", "ordinal").alias("area"))
    return items.join(first, "name", "left").select("doc_id", "id", "area")


def uncovered_areas(matches: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, area): areas of the template that no item of a document matched."""
    every = matches.select("doc_id").distinct().crossJoin(F.broadcast(areas.select("area")))
    return every.join(matches.select("doc_id", "area").distinct(), ["doc_id", "area"], "left_anti")


def system_neighbours(links: DataFrame) -> DataFrame:
    """(system, neighbour), both ways, once each."""
    return links.select(F.col("src").alias("system"), F.col("dst").alias("neighbour")).unionByName(links.select(F.col("dst").alias("system"), F.col("src").alias("neighbour"))).distinct()


def augment_systems(requests: DataFrame, known: DataFrame, always: DataFrame, links: DataFrame, hubs: DataFrame, chains: DataFrame) -> DataFrame:
    """(request_id, system, reason): systems that a request (request_id, system) should also
    have, of the known ones (system), for the first reason of: always (system, requires), if
    it has more than one; hubs (system) that neighbour two of its systems, if it has three;
    systems between the first and last present of a chain (chain, position, system) of which
    it has three."""
    have = requests.distinct()
    sized = have.withColumn("_n", F.count("*").over(Window.partitionBy("request_id")))
    required = sized.where("_n > 1").join(always, "system").select("request_id", F.col("requires").alias("system"), F.lit(1).alias("why")).join(known, "system", "left_semi")
    near = system_neighbours(links).join(hubs.select("system"), "system", "left_semi")
    hub = sized.where("_n >= 3").select("request_id", F.col("system").alias("neighbour")).join(near, "neighbour").groupBy("request_id", "system").agg(F.count("*").alias("_k")).where("_k >= 2").select("request_id", "system", F.lit(2).alias("why"))
    spans = have.join(chains, "system").groupBy("request_id", "chain").agg(F.count("*").alias("_k"), F.min("position").alias("_lo"), F.max("position").alias("_hi")).where("_k >= 3")
    between = spans.join(chains, "chain").where("position between _lo and _hi").select("request_id", "system", F.lit(3).alias("why")).join(known, "system", "left_semi")
    more = required.unionByName(hub).unionByName(between).join(have, ["request_id", "system"], "left_anti")
    why = F.min("why")
    return more.groupBy("request_id", "system").agg(F.when(why == 1, "always").when(why == 2, "hub").otherwise("chain").alias("reason"))


def missing_integrations(requests: DataFrame, items: DataFrame, links: DataFrame, external: str, most: int = MOST_ADDED) -> DataFrame:
    """(request_id, system, unit_id, complexity): an integration item for each link (ordinal,
    src, dst, unit_id, criticality) with both ends in a request (request_id, system), none
    of them ``external``, unless an item (request_id, system, unit_id) of either end covers
    it or an earlier link gave the same; the ``most`` most complex, in the links' order.

    Of links that have ends and unit in common only the first can give anything.  Requests
    and items are dealt by request once, and a request's row holds no more systems and items
    than the links name; its links are found and compared where it is then."""
    complexity = F.coalesce(*[F.when(F.col("criticality") == k, v) for k, v in COMPLEXITY.items()], F.lit("medium"))
    inner = links.where((F.col("src") != external) & (F.col("dst") != external))
    first = stored(inner.groupBy("src", "dst", "unit_id").agg(F.min(F.struct("ordinal", complexity.alias("complexity"))).alias("f")).select("src", "dst", "unit_id", "f.*"))
    ends = first.select(F.explode(F.array("src", "dst")).alias("system"), "unit_id").distinct()
    have = requests.where("request_id is not null").join(ends.select("system").distinct(), "system", "left_semi").groupBy("request_id").agg(F.collect_set("system").alias("_systems"))
    covered = items.join(ends, ["system", "unit_id"], "left_semi").groupBy("request_id").agg(F.collect_set(F.struct("system", "unit_id")).alias("_covered"))
    gives = first.groupBy("src").agg(F.collect_list(F.struct("dst", "unit_id", "ordinal", "complexity")).alias("_gives"))
    near = have.join(covered, "request_id", "left").withColumn("src", F.explode("_systems")).join(gives, "src")
    near = near.withColumn("l", F.explode(F.filter("_gives", lambda g: F.array_contains("_systems", g["dst"])))).select("request_id", "src", "l.*", "_covered")
    covers = lambda side: F.coalesce(F.array_contains("_covered", F.struct(F.col(side).alias("system"), "unit_id")), F.lit(False))
    met = near.where(~covers("src") & ~covers("dst")).drop("_covered")
    # a link also finds what an earlier one gave its destination
    told = met.withColumn("_e", F.explode(F.array(F.struct(F.col("src").alias("system"), F.lit(True).alias("gives")), F.struct(F.col("dst").alias("system"), F.lit(False).alias("gives")))))
    given = F.min(F.when(F.col("_e.gives"), F.col("ordinal"))).over(Window.partitionBy("request_id", "unit_id", "_e.system"))
    rows = told.withColumn("_first", given).where("not _e.gives and (unit_id is null or _first is null or _first >= ordinal)")
    one = rows.groupBy("request_id", F.col("src").alias("system"), "unit_id").agg(F.min(F.struct("ordinal", "complexity")).alias("f"))
    place = F.when(F.col("f.complexity") == "complex", 0).when(F.col("f.complexity") == "medium", 1).otherwise(2)
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy(place, "f.ordinal"))
    return one.withColumn("_n", nth).where(F.col("_n") <= most).select("request_id", "system", "unit_id", "f.complexity")

"""Entities named in texts, links of documents and chunks to them, rows of a service graph."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import CONFIDENCE, rank
from ..functions.text import meta_intent, norm_path, norm_topic, query_type, tokenize
from ..sources.stages import stored

#: words of a term at most, and bytes of terms that are sent to every task
LONGEST, SENT_BYTES = 4, 16 << 20


def find_terms(texts: DataFrame, terms: DataFrame, longest: int = LONGEST, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(id, term, count): how often texts (id, text) name terms (term, of at most ``longest``
    words), in any case, as whole words.  Read from the left, the longest term at a place
    counts and what it covers is not looked at again.  Terms of the same words count for the
    smallest.  A text is the work of one task; rows of one id are added up.

    Terms of up to ``sent_bytes`` together are sent to the tasks; more are joined by their
    first words with the places where those stand."""
    words = F.filter(tokenize(F.col("term")), lambda w: w != "")
    wanted = terms.select("term", words.alias("w")).where(F.size("w").between(1, longest)).groupBy("w").agg(F.min("term").alias("term"))
    wanted = stored(wanted.select(F.array_join("w", " ").alias("gram"), F.col("w")[0].alias("first"), F.size("w").alias("n"), "term"))
    tokens = texts.select("id", tokenize(F.coalesce("text", F.lit(""))).alias("w"))
    size = wanted.agg(F.sum(F.octet_length("gram") + F.octet_length("term"))).first()[0] or 0
    found = _by_sent_terms(tokens, wanted, longest) if size <= sent_bytes else _by_joined_terms(tokens, wanted)
    return found.groupBy("id", "term").agg(F.sum("count").alias("count"))


def _by_sent_terms(tokens: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    """(id, term, count) with all terms in every task; only words that begin a term are looked at."""
    rows = wanted.toArrow().to_pylist()
    sent = tokens.sparkSession.sparkContext.broadcast(({r["gram"]: r["term"] for r in rows}, {r["first"] for r in rows}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, firsts = sent.value
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            begins = np.flatnonzero(np.array([x in firsts for x in names], bool)[codes]) if len(names) else codes
            of = np.searchsorted(ends, begins, "right")
            counts: Counter[tuple[int, str]] = Counter()
            free = 0
            for at, row in zip(begins.tolist(), of.tolist(), strict=True):
                if at < free:
                    continue
                here = [names[c] for c in codes[at : min(at + longest, int(ends[row]))]]
                for n in range(len(here), 0, -1):
                    term = grams.get(" ".join(here[:n]))
                    if term is not None:
                        counts[row, term] += 1
                        free = at + n
                        break
            rows = pa.array([r for r, _ in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["id", "term", "count"])

    return tokens.mapInArrow(run, f"id {dict(tokens.dtypes)['id']}, term string, count long")


def _by_joined_terms(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, term, count) with terms joined to the places of their first words."""
    numbered = stored(tokens.withColumn("row", F.monotonically_increasing_id()))
    places = numbered.select("row", F.posexplode("w").alias("at", "first"))
    begun = places.join(wanted.groupBy("first").agg(F.sort_array(F.collect_set("n"), asc=False).alias("sizes")), "first")
    grams = begun.groupBy("row").agg(F.collect_list(F.struct("at", "sizes")).alias("b")).join(numbered, "row")
    grams = grams.select("row", "id", "w", F.explode("b").alias("b")).select("row", "id", "b.at", F.explode("b.sizes").alias("n"), "w").where("at + n <= size(w)")
    met = grams.select("row", "id", "at", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("gram")).join(wanted.select("gram", "term"), "gram")
    kind = dict(tokens.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = None, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (row, at, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                if row != now:
                    now, free = row, 0
                if at >= free:
                    keep[i], free = True, at + n
            yield batch.select([1, 4]).filter(pa.array(keep))

    ordered = met.select("row", "id", "at", "n", "term").repartition("row").sortWithinPartitions("row", "at", F.desc("n"))
    return ordered.mapInArrow(run, f"id {kind}, term string").groupBy("id", "term").agg(F.count("*").alias("count"))


def resolve_entities(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, rank, term, entity, candidates): entities that a text names, by terms (term,
    entity, confidence): a term of several entities lists them and names none.  The best
    first: unambiguous, then by confidence, then the longest term (ties: by term)."""
    sure = terms.groupBy("term").agg(F.sort_array(F.collect_set("entity")).alias("candidates"), F.max(rank("confidence", CONFIDENCE)).alias("_c"))
    rows = find_terms(texts, terms).join(sure, "term").withColumn("_one", F.size("candidates") == 1)
    order = Window.partitionBy("id").orderBy(F.desc("_one"), F.desc_nulls_last("_c"), F.desc(F.length("term")), "term")
    return rows.select("id", F.row_number().over(order).alias("rank"), "term", F.when(F.col("_one"), F.col("candidates")[0]).alias("entity"), "candidates")


def route_questions(questions: DataFrame, services: DataFrame) -> DataFrame:
    """(id, kind, sid, meta) of questions (id, question): the kind by ``query_type``, the service
    (sid, name of at most four words) that a question names as whole words (the longest
    name, then the smallest sid), and whether it is a greeting."""
    found = find_terms(questions.select("id", F.col("question").alias("text")), services.select(F.col("name").alias("term")))
    named = services.select(F.array_join(tokenize(F.col("name")), " ").alias("gram"), "sid")
    met = found.withColumn("gram", F.array_join(tokenize(F.col("term")), " ")).join(named, "gram").groupBy("id").agg(F.min_by("sid", F.struct(-F.length("gram"), F.col("sid"))).alias("sid"))
    rows = questions.join(met, "id", "left")
    return rows.select("id", query_type(F.col("question"), F.col("sid")).alias("kind"), "sid", meta_intent(F.col("question")).alias("meta"))


def _counted(docs: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, term, sid, tier, count) of terms that name a service, and (id, term, sid, count)
    of the candidates of those that don't."""
    whole = aliases.groupBy("term").agg((F.count_distinct("sid") > 1).alias("_many"), F.bool_or("canonical").alias("_known"))
    rows = stored(find_terms(docs, aliases)).join(aliases, "term").join(whole, "term")
    open_ = F.col("_many") & ~F.col("_known")
    tier = F.when(F.col("canonical") | (F.col("confidence") == "manual"), "high").when(F.col("_many"), "weak").when(F.col("term").contains(" ") & F.col("confidence").isin("high", "medium"), "medium").otherwise("weak")
    return rows.where(~open_).select("id", "term", "sid", tier.alias("tier"), "count"), rows.where(open_).select("id", "term", "sid", "count")


def link_documents(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, sid, confidence, matched, hits): services that documents (id, text) name, by
    aliases (term, sid, confidence, canonical).

    A canonical name or one given by hand is high; an unambiguous one of several words and
    at least medium confidence is medium; two weak ones, one of several words, are low; less
    is no link.  A term of several services counts only for the one that the document
    links to already, if there is exactly one."""
    return _linked(*_counted(docs, aliases))


def _linked(sure: DataFrame, unsure: DataFrame) -> DataFrame:
    weak = F.col("tier") == "weak"
    sums = sure.groupBy("id", "sid").agg(F.bool_or(F.col("tier") == "high").alias("_h"), F.bool_or(F.col("tier") == "medium").alias("_m"), F.count_distinct(F.when(weak, F.col("term"))).alias("_w"), F.bool_or(weak & F.col("term").contains(" ")).alias("_s"), F.collect_set("term").alias("_t"), F.sum("count").alias("_n"))
    level = F.when(F.col("_h"), "high").when(F.col("_m"), "medium").when((F.col("_w") >= 2) & F.col("_s"), "low")
    links = sums.select("id", "sid", level.alias("confidence"), "_t", "_n").where("confidence is not null")
    linked = unsure.join(links.select("id", "sid"), ["id", "sid"])
    only = linked.withColumn("_k", F.count("*").over(Window.partitionBy("id", "term"))).where("_k = 1").groupBy("id", "sid").agg(F.collect_set("term").alias("_t2"), F.sum("count").alias("_n2"))
    rows = links.join(only, ["id", "sid"], "left")
    matched = F.sort_array(F.array_union("_t", F.coalesce("_t2", F.array().cast("array<string>"))))
    return rows.select("id", "sid", "confidence", matched.alias("matched"), (F.col("_n") + F.coalesce("_n2", F.lit(0))).alias("hits"))


def skipped_terms(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, term, candidates): terms of several services that no single link settles."""
    sure, unsure = _counted(docs, aliases)
    links = _linked(sure, unsure).select("id", "sid", F.lit(1).alias("_l"))
    rows = unsure.join(links, ["id", "sid"], "left").groupBy("id", "term").agg(F.count("_l").alias("_k"), F.sort_array(F.collect_set("sid")).alias("candidates"))
    return rows.where("_k != 1").select("id", "term", "candidates")


def tag_chunks(chunks: DataFrame, links: DataFrame, former: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with service_ids, tags): every chunk (chunk_id, parent) gets the sorted
    services that its document (links: id, sid) links to; of former tags (chunk_id, sid,
    source) those of ``source`` are replaced by the new ones."""
    ids = links.groupBy(F.col("id").alias("parent")).agg(F.sort_array(F.collect_set("sid")).alias("service_ids"))
    tagged = chunks.join(ids, "parent", "left").withColumn("service_ids", F.coalesce("service_ids", F.array().cast("array<string>")))
    new = tagged.select("chunk_id", F.explode("service_ids").alias("sid"), F.lit(source).alias("source"))
    return tagged, former.where(F.col("source") != source).select("chunk_id", "sid", "source").unionByName(new)


def link_chunks(chunks: DataFrame, endpoints: DataFrame, topics: DataFrame, most: int = 20) -> DataFrame:
    """(chunk_id, entity, role): what chunks (chunk_id, sid, text) describe: endpoints
    (entity, sid, method, path) of their service that a heading line (primary) or a table
    row (index) names by method and path, topics (entity, name) that stand in backticks
    (events).  The first role of a chunk and entity counts, and ``most`` index rows."""
    lines = chunks.select("chunk_id", "sid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    role = F.when(F.col("line").startswith("#"), "primary").when(F.col("line").startswith("|"), "index")
    call = r"\b(GET|POST|PUT|PATCH|DELETE)\b[ |`]+(/[^\s|`]*)"
    named = lines.withColumn("role", role).where("role is not null").withColumn("m", F.regexp_extract("line", call, 1)).where("m != ''")
    named = named.select("chunk_id", "sid", "at", "role", F.col("m").alias("method"), norm_path(F.regexp_extract("line", call, 2)).alias("_p"))
    hits = named.join(endpoints.select("entity", "sid", F.upper("method").alias("method"), norm_path(F.col("path")).alias("_p")), ["sid", "method", "_p"]).select("chunk_id", "entity", "at", "role")
    quoted = lines.select("chunk_id", "at", F.explode(F.regexp_extract_all("line", F.lit("`([^`]+)`"), 1)).alias("name")).select("chunk_id", "at", norm_topic(F.col("name")).alias("name"))
    events = quoted.join(topics.select("entity", norm_topic(F.col("name")).alias("name")), "name").select("chunk_id", "entity", "at", F.lit("events").alias("role"))
    first = hits.unionByName(events).groupBy("chunk_id", "entity").agg(F.min(F.struct("at", "role")).alias("f")).select("chunk_id", "entity", "f.*")
    nth = F.row_number().over(Window.partitionBy("chunk_id", "role").orderBy("at", "entity"))
    return first.withColumn("_n", nth).where((F.col("role") != "index") | (F.col("_n") <= most)).select("chunk_id", "entity", "role")


def service_graph_rows(services: DataFrame, routes: DataFrame, access: DataFrame, settings: DataFrame, messaging: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (label, id, name) and edges (source, rel_type, target) of what
    services (sid, name), routes (sid, method, path), access (sid, store, table, access),
    settings (sid, key) and messaging (sid, topic, direction) say, once each."""
    node = lambda df, label, key, name: df.select(F.lit(label).alias("label"), key.alias("id"), name.alias("name"))
    endpoint = F.concat_ws(" ", "sid", F.upper("method"), norm_path(F.col("path")))
    table_id, key_id, topic_id = F.concat_ws(".", "store", "table"), F.concat_ws(":", "sid", "key"), norm_topic(F.col("topic"))
    nodes = node(services, "Service", F.col("sid"), F.col("name")).unionByName(node(routes, "Endpoint", endpoint, F.concat_ws(" ", F.upper("method"), "path")))
    nodes = nodes.unionByName(node(access, "DataStore", table_id, F.col("table"))).unionByName(node(settings, "ConfigKey", key_id, F.col("key"))).unionByName(node(messaging, "Topic", topic_id, topic_id))
    edge = lambda df, rel, target: df.select(F.col("sid").alias("source"), rel.alias("rel_type"), target.alias("target"))
    how = F.when(F.lower("access").isin("write", "both", "writes"), "WRITES").otherwise("READS")
    edges = edge(routes, F.lit("EXPOSES"), endpoint).unionByName(edge(access, how, table_id)).unionByName(edge(settings, F.lit("USES_CONFIG"), key_id)).unionByName(edge(messaging, F.when(F.col("direction") == "publish", "PUBLISHES").otherwise("SUBSCRIBES"), topic_id))
    both = edge(access.where(F.lower("access") == "both"), F.lit("READS"), table_id)
    return nodes.groupBy("label", "id").agg(F.min("name").alias("name")), edges.unionByName(both).distinct()

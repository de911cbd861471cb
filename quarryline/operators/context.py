"""What is put around an answer: describing chunks, neighbours, chunks of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach
from .retrieval import bm25_topk

#: order of the roles in which a chunk describes an entity
ROLES = ("primary", "events", "index")


def describing_chunks(asked: DataFrame, describes: DataFrame, chunks: DataFrame, per_entity: int = 2, max_chars: int = 6000) -> DataFrame:
    """(question_id, entity, chunk_id, text): the best chunks of each asked entity
    (question_id, ordinal, entity), by role and then the shortest text (ties: chunk_id), at
    most ``per_entity`` each.  A chunk goes to the question's first entity that has it; a
    question's texts, in order, take ``max_chars`` in all, and the last one is cut."""
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.lit(0))
    rank = F.when(role == 0, len(ROLES) + 1).otherwise(role)
    best = describes.groupBy("entity", "chunk_id").agg(F.min(rank).alias("role"))
    rows = asked.groupBy("question_id", "entity").agg(F.min("ordinal").alias("ordinal")).join(best, "entity").join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("n", F.length("text"))
    first = rows.withColumn("_f", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy("ordinal", "entity"))).where("_f = 1")
    top = first.withColumn("nth", F.row_number().over(Window.partitionBy("question_id", "entity").orderBy("role", "n", "chunk_id"))).where(F.col("nth") <= per_entity)
    before = F.sum("n").over(Window.partitionBy("question_id").orderBy("ordinal", "entity", "nth")) - F.col("n")
    kept = top.withColumn("_b", before).where(F.col("_b") < max_chars)
    return kept.select("question_id", "entity", "chunk_id", F.expr(f"substring(text, 1, cast({max_chars} - _b as int))").alias("text"))


def keyword_pages(queries: DataFrame, pages: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): pages (page_id, title) by keywords of their titles."""
    return bm25_topk(queries, pages, k, "page_id", "title")


def context_block(asked: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2, most: int = 20) -> DataFrame:
    """(question_id, block): a line for each neighbour within so many hops, either way, of a
    question's documents (question_id, node): name and the first 200 characters of the
    description; the nearest first (ties: source_id), each once, ``most`` at most."""
    near = reach(edges, asked.select("node").distinct(), hops, undirected=True).where("root != node")
    rows = asked.withColumnRenamed("node", "root").join(near, "root").groupBy("question_id", "node").agg(F.min("hop").alias("hop"))
    rows = rows.join(entities.select(F.col("source_id").alias("node"), "name", "description"), "node").where("name != ''")
    line = F.concat(F.lit("- "), F.col("name"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.substring("description", 1, 200))).otherwise(F.lit("")))
    top = rows.withColumn("nth", F.row_number().over(Window.partitionBy("question_id").orderBy("hop", "node"))).where(F.col("nth") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"])
    return top.groupBy("question_id").agg(F.array_join(lines, "\n").alias("block"))


def per_service_topk(chains: DataFrame, hits: DataFrame, services: int = 5, chunks: int = 2) -> DataFrame:
    """(question_id, ref, service, chunk_id): for a question about a flow, its first services
    (question_id, service, hop) by hop and name, and the best hits (question_id, service,
    chunk_id, score) of each, numbered from 1 in that order."""
    first = chains.groupBy("question_id", "service").agg(F.min("hop").alias("hop")).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("hop", "service"))).where(F.col("place") <= services)
    best = hits.join(first, ["question_id", "service"]).withColumn("nth", F.row_number().over(Window.partitionBy("question_id", "service").orderBy(F.desc("score"), "chunk_id"))).where(F.col("nth") <= chunks)
    return best.withColumn("ref", F.row_number().over(Window.partitionBy("question_id").orderBy("place", "nth"))).select("question_id", "ref", "service", "chunk_id")

"""Keyword, vector and fused rankings for batches of questions; duplicates of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import authority
from ..functions.text import tokenize

K1, B, EPSILON = 1.5, 0.75, 0.25


def metadata_filter(rows: DataFrame, equal: dict[str, str]) -> DataFrame:
    """Every pair must match, a missing field never does; marked duplicates go."""
    out = rows.where(~F.coalesce(F.col("is_duplicate"), F.lit(False))) if "is_duplicate" in rows.columns else rows
    for k, v in equal.items():
        out = out.where(F.col(k) == v)
    return out


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = 30, id_col: str = "chunk_id", text_col: str = "display_text", keep: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): Okapi BM25 with repeated query words counted each
    time, negative idf replaced by a quarter of the mean idf, ties by id.  A hit shares a
    word with the query.  ``keep`` (id) restricts hits after corpus statistics.

    One pass counts the chunks of every word (a null word counts all chunks and their
    lengths); only words that a question asks for are counted within chunks."""
    tokens = chunks.select(F.col(id_col).alias("id"), tokenize(F.coalesce(text_col, F.lit(""))).alias("tokens"))
    words = F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string"))))
    counts = tokens.select(F.size("tokens").alias("dl"), words.alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("words"))
    stats = counts.where("term is null").select(F.col("df").alias("docs"), (F.col("words") / F.col("df")).alias("avgdl"))
    raw = counts.where("term is not null").crossJoin(F.broadcast(stats)).withColumn("idf", F.ln(F.col("docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    asked = queries.select("query_id", F.explode(tokenize("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    wanted = asked.select("term").distinct()
    idf = raw.join(wanted, "term", "left_semi").crossJoin(F.broadcast(mean))
    idf = idf.select("term", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    posted = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    met = posted.join(idf, "term").join(asked, "term")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qf") * weight), 6).alias("score"))
    if keep is not None:
        scores = scores.join(keep.select("id"), "id", "left_semi")
    return _top(scores, k)


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def unit(vector):
    """A vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


#: questions, and vectors, that meet in one group
QUESTIONS, VECTORS = 4096, 8192


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 30, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): cosine of queries (query_id, vector) with vectors
    (id, vector), of those in ``keep`` (id) if given, ties by id.  Both are dealt into parts of a few thousand by hash, every
    block of questions meets every part of the vectors in a group of its own, and only the
    k best of each meeting go on."""
    vectors = vectors if keep is None else vectors.join(keep.select("id").distinct(), "id", "left_semi")
    blocks, parts = max(1, -(-queries.count() // QUESTIONS)), max(1, -(-vectors.count() // VECTORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", unit(F.col("vector")).alias("v"), F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)").alias("block"), every(parts).alias("part"))
    c = vectors.select("id", unit(F.col("vector")).alias("v"), every(blocks).alias("block"), F.expr(f"cast(pmod(xxhash64(id), {parts}) as int)").alias("part"))

    def best(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(known):
            return pd.DataFrame({"query_id": asked["query_id"][:0], "id": known["id"][:0], "score": pd.Series([], dtype=float)})
        names = known["id"].to_numpy()
        scores = np.round(np.stack(known["v"].to_numpy()) @ np.stack(asked["v"].to_numpy()).T, 6)
        tops = [np.lexsort((names, -scores[:, j]))[:k] for j in range(len(asked))]
        n = [len(t) for t in tops]
        return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), n), "id": names[np.concatenate(tops)], "score": np.concatenate([scores[t, j] for j, t in enumerate(tops)])})

    kinds = dict(vectors.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    met = q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInPandas(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return _top(met, k)


def rrf(ranked: DataFrame, k: int = 60, limit: int = 30) -> DataFrame:
    """(query_id, rank, id, score): reciprocal rank fusion of (query_id, list, id, rank);
    an id counts once in each list, ties by id."""
    first = ranked.groupBy("query_id", "list", "id").agg(F.min("rank").alias("r"))
    return _top(first.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score")), limit)


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, k: int = 30, id_col: str = "chunk_id", text_col: str = "display_text", question_vectors: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """BM25 and, where there are vectors, cosine rankings fused by reciprocal ranks.  The
    questions' vectors are those of ``queries``, or of a table (query_id, vector); ``keep``
    (id) restricts both lists, after the corpus statistics."""
    lists = bm25_topk(queries, chunks, k, id_col, text_col, keep).select("query_id", F.lit("sparse").alias("list"), "id", "rank")
    if vectors is not None:
        lists = lists.unionByName(dense_topk(queries if question_vectors is None else question_vectors, vectors, k, keep).select("query_id", F.lit("dense").alias("list"), "id", "rank"))
    return rrf(lists, limit=k)


def hydrate(fused: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Chunk fields for fused hits, the dense side's where it has the chunk."""
    d = dense.select("id", F.struct(*[c for c in dense.columns if c != "id"]).alias("_d"))
    s = sparse.select("id", F.struct(*[c for c in sparse.columns if c != "id"]).alias("_s"))
    rows = fused.join(d, "id", "left").join(s, "id", "left")
    shared = [c for c in dense.columns if c != "id" and c in sparse.columns]
    return rows.select(*fused.columns, *[F.coalesce(f"_d.{c}", f"_s.{c}").alias(c) for c in shared])


def rerank_topk(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The k best by the caller's score (null: input order), ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank", "id")
    return candidates.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def relevance_gate(hits: DataFrame, queries: DataFrame, least: float = 0.40, top: int = 5) -> DataFrame:
    """(query_id, best, answered): the best cosine of the first hits; none is refused."""
    best = hits.where(F.col("rank") <= top).groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) >= least).alias("answered"))


def exact_duplicates(chunks: DataFrame) -> DataFrame:
    """(chunk_id, canonical_id, is_duplicate): one canonical chunk for each text hash, of
    the highest authority, then the smallest id."""
    best = chunks.groupBy("text_hash").agg(F.max_by("chunk_id", F.struct(authority(F.col("doc_type")), -F.xxhash64("chunk_id"))).alias("_any"), F.max(authority(F.col("doc_type"))).alias("_rank"))
    ranked = chunks.join(best.select("text_hash", "_rank"), "text_hash").where(authority(F.col("doc_type")) == F.col("_rank"))
    least = ranked.groupBy("text_hash").agg(F.min("chunk_id").alias("canonical_id"))
    return chunks.join(least, "text_hash").select("chunk_id", "canonical_id", (F.col("chunk_id") != F.col("canonical_id")).alias("is_duplicate"))


#: rows of one group, and rows of a repo up to which every pair is compared
GROUP_ROWS, EXACT_ROWS = 1024, 16 * 1024
#: tables of random hyperplanes for larger repos, neighbouring buckets probed in each, and bits at most
TABLES, PROBES, MOST_BITS = 4, 3, 24


def _closest(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Each row's closest other row of the group above the threshold.  Rows that are all of one
    block, or both visitors of a bucket, meet elsewhere."""
    group = group.sort_values("id", kind="stable").reset_index(drop=True)
    v, ids, own, home = np.stack(group["v"].to_numpy()), group["id"].to_numpy(), group["own"].to_numpy(), group["home"].to_numpy()
    scores = v @ v.T
    scores[ids[:, None] == ids[None, :]] = -2
    if len(set(own)) > 1:
        scores[own[:, None] == own[None, :]] = -2
    scores[~(home[:, None] | home[None, :])] = -2
    best = scores.argmax(axis=1)
    value = np.round(scores[np.arange(len(ids)), best], 6)
    keep = value > threshold
    return pd.DataFrame({"id": ids[keep], "other": ids[best[keep]], "score": value[keep]})


def _in_blocks(rows: DataFrame, keys: list[str], threshold: float, kind: str) -> DataFrame:
    """(id, other, score) from rows (keys, id, v, home): the rows of equal keys are dealt into
    blocks by id, and every pair of blocks is one bounded group."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("blocks"))
    dealt = rows.join(counts, keys).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v", "home")
    return dealt.groupBy(*keys, "x", "y").applyInPandas(lambda g: _closest(g, threshold), f"id {kind}, other {kind}, score double")


def _buckets(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (repo_name, id, v, bits) in the bucket of their signs against the first ``bits``
    hyperplanes of each table (home), and as visitors in the buckets that differ in one of the
    ``PROBES`` signs that were nearest to change."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v, bits = np.stack(batch["v"].to_numpy()), batch["bits"].to_numpy()
            out = []
            for t in range(TABLES):
                planes = np.random.default_rng(1 + t).standard_normal((v.shape[1], MOST_BITS))
                margin = v @ planes
                used = np.arange(MOST_BITS) < bits[:, None]
                weight = np.where(used, 1 << np.arange(MOST_BITS), 0)
                code = ((margin > 0) * weight).sum(axis=1)
                near = np.argsort(np.where(used, np.abs(margin), np.inf), axis=1, kind="stable")[:, :PROBES]
                out.append(batch.assign(bucket=code * TABLES + t, home=True))
                for p in range(PROBES):
                    some = bits > p
                    moved = code ^ np.take_along_axis(weight, near[:, p : p + 1], axis=1)[:, 0]
                    out.append(batch.assign(bucket=moved * TABLES + t, home=False)[some])
            yield pd.concat(out)[["repo_name", "bucket", "id", "v", "home"]]

    repo = dict(rows.dtypes)["repo_name"]
    return rows.mapInPandas(run, f"repo_name {repo}, bucket bigint, id {kind}, v array<double>, home boolean")


def near_duplicates(chunks: DataFrame, threshold: float = 0.95, exact: bool = False, exact_rows: int = EXACT_ROWS, bucket_rows: int = GROUP_ROWS // 2) -> DataFrame:
    """(id, other, score): within a repo, each vector's closest other above the threshold.

    Repos of at most ``exact_rows`` (all of them, if ``exact``) are dealt into blocks of rows by
    id; every pair of blocks is met in one bounded group, so no pair is missed.  Of a larger
    repo, equal vectors are each other's closest; one of each goes into buckets of about
    ``bucket_rows`` by random hyperplanes, with probes of neighbouring buckets: a row is copied
    so often whatever its repo's size.  A pair just above a threshold of 0.95 is met with a
    probability of over 0.95 up to some ten million rows of a repo, closer pairs more surely."""
    kind = dict(chunks.dtypes)["chunk_id"]
    counts = chunks.groupBy("repo_name").agg(F.count("*").alias("_n"))
    rows = chunks.select("repo_name", F.col("chunk_id").alias("id"), unit(F.col("vector")).alias("v")).join(counts, "repo_name")
    few = rows if exact else rows.where(F.col("_n") <= exact_rows)
    found = _in_blocks(few.select("repo_name", "id", "v", F.lit(True).alias("home")), ["repo_name"], threshold, kind)
    if not exact:
        many = rows.where(F.col("_n") > exact_rows).withColumn("_same", F.xxhash64("v"))
        group = Window.partitionBy("repo_name", "_same", "v")
        told = many.withColumn("_first", F.min("id").over(group)).withColumn("_second", F.nth_value("id", 2).over(group.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        equal = told.where("_second is not null").select("id", F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("other"), F.lit(1.0).alias("score")).where(F.col("score") > threshold)
        bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(1), F.ceil(F.log2(F.col("_n") / bucket_rows)))).cast("int").alias("bits")
        met = _in_blocks(_buckets(told.where("id = _first").select("repo_name", "id", "v", bits), kind), ["repo_name", "bucket"], threshold, kind)
        found = found.unionByName(equal).unionByName(met)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def resolve_canonical(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """(duplicate_id, canonical_id): of a pair the one with less authority, then the
    larger id, is the duplicate; the order of a pair doesn't matter."""
    t = types.select("id", authority(F.col("doc_type")).alias("rank"))
    rows = pairs.join(t, "id").join(t.select(F.col("id").alias("other"), F.col("rank").alias("other_rank")), "other")
    wins = (F.col("rank") > F.col("other_rank")) | ((F.col("rank") == F.col("other_rank")) & (F.col("id") < F.col("other")))
    return rows.select(F.when(wins, F.col("other")).otherwise(F.col("id")).alias("duplicate_id"), F.when(wins, F.col("id")).otherwise(F.col("other")).alias("canonical_id")).distinct()

"""Ranking: BM25, exact vector similarity, reciprocal rank fusion, tiers, and how well they hit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import contains_any, tokens
from lodestar.operators.vector_scan import candidates

#: Queries that one ranking takes at most, so that the query side of a join is of proven size.
MOST_QUERIES = 10_000


def top_k(ranked: DataFrame, k: int, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the rank is pushed down as a window group limit."""
    return ranked.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def checked_queries(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """``queries``, marked for broadcast only when there are at most ``most``; else left to a shuffled join."""
    return F.broadcast(queries) if queries.limit(most + 1).count() <= most else queries


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, by: list[str] | None = None) -> DataFrame:
    """``chunks(chunk_id, text[, by])``, ``queries(query_id, question)`` → ``(by, query_id, chunk_id, score)``.

    Okapi BM25 with the non-negative idf ``ln(1 + (N - n + .5) / (n + .5))``; a query's repeated terms count each time.
    Only postings of query terms are kept before the first shuffle. Scores are rounded to 6 places, so that ranks do
    not hang on the order of a sum. ``by`` columns (a chunking strategy) are indexes of their own.
    """
    by = by or []
    tokened = chunks.select(*by, "chunk_id", tokens(F.col("text")).alias("_t"))
    lengths = tokened.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(F.size("_t")).alias("_avg"))
    wanted = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    terms = checked_queries(wanted.select("term").distinct())
    postings = tokened.select(*by, "chunk_id", F.size("_t").alias("_len"), F.explode("_t").alias("term")).join(terms, "term", "left_semi")
    postings = postings.groupBy(*by, "chunk_id", "_len", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy(*by, "term").agg(F.count("*").alias("_df"))
    scored = postings.join(df, [*by, "term"])
    scored = scored.join(F.broadcast(lengths), by) if by else scored.crossJoin(F.broadcast(lengths))  # one row of totals
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    scored = scored.select(*by, "chunk_id", "term", weight.alias("w")).join(checked_queries(wanted), "term")
    return scored.groupBy(*by, "query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("qf")), 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision, rounded to 4 places."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 4)


def nearest_exact(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, equal: tuple[str, str] | None = None) -> DataFrame:
    """``vectors(chunk_id, v)``, ``queries(query_id, q)`` → ``(query_id, chunk_id, score, rank)``, exact.

    The query side is broadcast; more than ``MOST_QUERIES`` are dealt into blocks of about half as many, each with a
    ranking of its own. Pairs that matrix products show to be too far apart get no exact score. A filter comes before the
    ranking: ``equal`` names a column of the vectors and one of the queries; any other ``where`` scores every pair.
    """
    queries = queries.select("query_id", "q", *[c for c in queries.columns if c not in ("query_id", "q")])
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        blocks = -(-2 * queries.count() // MOST_QUERIES)
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        return reduce(DataFrame.unionByName, [_nearest(vectors, queries.where(block == n), k, where, equal) for n in range(blocks)])
    return _nearest(vectors, queries, k, where, equal)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None, equal: tuple[str, str] | None) -> DataFrame:
    if where is None:
        listed = queries.collect()  # at most MOST_QUERIES
        numbered = vectors.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(listed)], T.StructType([T.StructField("_place", T.IntegerType()), *queries.schema.fields]))
        pairs = candidates(vectors, listed, k, equal).join(F.broadcast(numbered), "_place").drop("_place")
        pairs = pairs.where(F.col(equal[0]) == F.col(equal[1])) if equal else pairs
    else:
        gathered = queries.agg(F.collect_list(F.struct(*queries.columns)).alias("_qs"))
        pairs = vectors.crossJoin(F.broadcast(gathered)).withColumn("_q", F.explode("_qs")).select(*vectors.columns, "_q.*").where(where)
        pairs = pairs.where(F.col(equal[0]) == F.col(equal[1])) if equal else pairs
    return top_k(pairs.withColumn("score", cosine(F.col("v"), F.col("q"))), k, ["query_id"], F.desc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "score", "rank")


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists ``(query_id, chunk_id, rank)``; a missing side counts as one rank past the
    longer list of its query. → ``(query_id, chunk_id, vector_rank, bm25_rank, rrf_score, rank)``."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    w = keyword.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    both = v.join(w, ["query_id", "chunk_id"], "full")
    query = Window.partitionBy("query_id")
    penalty = F.greatest(F.count("vector_rank").over(query), F.count("bm25_rank").over(query)) + 1
    both = both.withColumn("_p", penalty)
    score = 1 / (k + F.coalesce("vector_rank", "_p")) + 1 / (k + F.coalesce("bm25_rank", "_p"))
    both = both.withColumn("rrf_score", F.round(score, 6)).drop("_p")
    return both.withColumn("rank", F.row_number().over(query.orderBy(F.desc("rrf_score"), "chunk_id")))


def rescue(fused: DataFrame, chunks: DataFrame, codes: DataFrame, preamble: Column, n: int) -> DataFrame:
    """Chunks with one of the query's exact codes first, then others, then preambles, each in fused order.

    The whole fused list is looked at. ``codes(query_id, codes)``; a query without codes keeps the fused order.
    """
    joined = chunks.join(checked_queries(fused.withColumnRenamed("rank", "fused_rank")), "chunk_id").join(codes, "query_id", "left")
    has = F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0
    tier = F.when(~has, 0).when(contains_any(F.col("text"), F.col("codes")), 0).when(~preamble, 1).otherwise(2)
    joined = joined.withColumn("tier", tier)
    return top_k(joined, n, ["query_id"], F.asc("tier"), F.asc("fused_rank")).select("query_id", "chunk_id", "tier", "fused_rank", "rank")


def first_hit(hits: DataFrame, golden: DataFrame, hit: Column, k: int) -> DataFrame:
    """``golden(query_id, …)`` with ``hit_rank``, the first rank of ``hits`` at which ``hit`` holds (null: none), and
    ``hit_at_k``."""
    found = hits.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("hit_rank"))
    return golden.join(found, "query_id", "left").withColumn("hit_at_k", F.coalesce(F.col("hit_rank") <= k, F.lit(False)))


def failure_label(fragment_in_3: Column, fragment_in_5: Column, form_in_5: Column) -> Column:
    """``G`` where the fragment was found but the hit was not counted, else ``R``, with the reason."""
    reason = F.when(fragment_in_3, "fragment in top 3").when(fragment_in_5, "fragment in top 5 only").when(form_in_5, "form without fragment").otherwise("form not found")
    return F.struct(F.when(fragment_in_3, "G").otherwise("R").alias("label"), reason.alias("reason"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Hits by question before and after: ``fixed``, ``broke``, ``same hit`` or ``same miss``."""
    a = after.select("query_id", F.col("hit_at_k").alias("after_hit"))
    joined = before.select("query_id", F.col("hit_at_k").alias("before_hit")).join(a, "query_id", "left").withColumn("after_hit", F.coalesce("after_hit", F.lit(False)))
    status = F.when(~F.col("before_hit") & F.col("after_hit"), "fixed").when(F.col("before_hit") & ~F.col("after_hit"), "broke").when(F.col("after_hit"), "same hit").otherwise("same miss")
    return joined.withColumn("status", status)

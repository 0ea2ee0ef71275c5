"""An inverted index on storage: texts are tokenised once, and searches read what can still be among the best.

Chunks are dealt to cells of about ``CELL``. Postings lie sorted by term and cell; a block is a term's postings of one
cell, and its first posting carries the largest frequency and the smallest length among them, which bound what the term
weighs there. For a query these bounds of a cell add up to one that no chunk of the cell exceeds. The cells with the
highest bounds are scored first; their k-th best score is a threshold, and only cells whose bound reaches it are scored
at all.

Postings of the query's terms are dealt by cell once, before they meet the queries: a cell's scores are then added up
where its postings lie, and only the best of each query travel further.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import tokens
from lodestar.operators.retrieval import checked_queries, top_k
from lodestar.sources.shared import hadoop, new_folder, written

#: Chunks of a cell on average, cells that are scored for the threshold, and the fewest and most directories that terms
#: are dealt to. Smaller cells have closer bounds, but nearly as many blocks as postings.
CELL, FIRST = 512, 2
BUCKETS = (8, 256)
#: Chunks that share the files of a bucket, and chunks for each directory.
CHUNKS_A_FILE, CHUNKS_A_BUCKET = 131_072, 4_096
#: Scores are rounded to 6 places; a bound must be below the threshold by more than that to be passed over.
MARGIN = 1e-5


@dataclass(frozen=True)
class Index:
    """Where an index lies: ``posts`` and ``terms`` by bucket, ``stats`` and the ids of ``chunks`` below ``folder``."""

    folder: str
    by: tuple[str, ...]
    buckets: int
    schemas: dict[str, str]

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(self.schemas[part]))).parquet(f"{self.folder}/{part}")

    def exists(self, spark: SparkSession) -> bool:
        _, at, system = hadoop(spark, f"{self.folder}/about/_SUCCESS")
        return system.exists(at)


def open_index(spark: SparkSession, folder: str) -> Index:
    """An index that was built before, in this application or another."""
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    return Index(folder, tuple(about["by"]), about["buckets"], about["schemas"])


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _weight(tf, length, average, k1: float, b: float):
    """Okapi BM25's weight of a term without its idf; it grows with ``tf`` and falls with ``length``."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def build_index(chunks: DataFrame, folder: str | None = None, by: Sequence[str] = ()) -> Index:
    """Index ``chunks(by, chunk_id, text)`` for :func:`search`, below ``folder`` or a new one of the shared folder.

    Postings hold frequencies and lengths; what a term weighs is worked out at search, where the number of chunks and
    their average length are known. Null texts have no terms but count as chunks. Each value of ``by`` (a chunking
    strategy) is an index of its own. A (term, cell) is the largest group, so a term of all chunks is dealt over all cells.
    """
    spark, by = chunks.sparkSession, list(by)
    folder = folder or new_folder(spark, "index")
    schemas: dict[str, str] = {}

    def put(part: str, df: DataFrame) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy("bucket") if "bucket" in df.columns else writer).parquet(f"{folder}/{part}")
        schemas[part] = df.schema.json()
        return spark.read.schema(df.schema).parquet(f"{folder}/{part}")

    ids = put("chunks", chunks.select(*by, "chunk_id"))
    n = ids.count()
    cells, buckets = max(1, -(-n // CELL)), min(max(BUCKETS[0], n // CHUNKS_A_BUCKET), BUCKETS[1])
    cell = F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).cast("int")
    bucket, part = _bucket(buckets), F.floor(cell / max(1, CHUNKS_A_FILE // CELL)).cast("int")
    # A text's tokens are counted where it is read: sorted, equal ones stand together, and a term counts up to the next.
    starts = "filter(sequence(1, size(t)), i -> i = 1 OR t[i - 1] <> t[i - 2])"
    counted = f"""IF(size(t) = 0, array(), transform(array({starts}), s -> transform(s, (i, k) -> named_struct('term', t[i - 1], 'tf', coalesce(get(s, k + 1), size(t) + 1) - i)))[0])"""
    tokened = chunks.select(*by, "chunk_id", F.sort_array(tokens(F.col("text"))).alias("t"))
    posts = tokened.select(*by, "chunk_id", F.size("t").alias("len"), F.explode(F.expr(counted).cast("array<struct<term: string, tf: int>>")).alias("_t"))
    # Dealt once, as the files will lie; what follows from the columns is not sent along. The number of tasks is given, or
    # tasks would be joined by their compressed bytes and sort a hundred times as many.
    tasks = buckets * -(-cells // max(1, CHUNKS_A_FILE // CELL))
    posts = posts.select(*by, "chunk_id", "len", "_t.term", "_t.tf").repartition(tasks, bucket, part)
    posts = posts.select(bucket.alias("bucket"), part.alias("part"), *by, "term", cell.alias("cell"), "chunk_id", "tf", "len")
    block = Window.partitionBy("bucket", "part", *by, "term", "cell").orderBy("chunk_id")
    whole, first = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), F.row_number().over(block) == 1
    posts = posts.withColumns({"most_tf": F.when(first, F.max("tf").over(whole)), "least_len": F.when(first, F.min("len").over(whole))})
    posts = put("posts", posts.drop("part"))
    terms = posts.groupBy("bucket", *by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    terms = put("terms", terms.repartition("bucket").sortWithinPartitions("bucket", "term"))
    counts, totals = ids.groupBy(*by).agg(F.count("*").alias("n")), terms.groupBy(*by).agg(F.sum("total").alias("total"))
    stats = counts.join(totals, by, "left") if by else counts.crossJoin(F.broadcast(totals))  # a row each
    put("stats", stats.select(*by, "n", F.try_divide(F.coalesce("total", F.lit(0)), "n").alias("average")))
    about = json.dumps({"by": by, "buckets": buckets, "schemas": schemas})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{folder}/about")
    return Index(folder, tuple(by), buckets, schemas)


def _asked(index: Index, queries: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the queries' terms weigh in the index, the postings of their buckets, and the bounds of the cells by query."""
    spark, by = queries.sparkSession, list(index.by)
    wanted = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    wanted = written(wanted.withColumn("bucket", _bucket(index.buckets)), "query-terms")
    # A number for each bucket, so that other directories are not listed in a plan.
    used = [r[0] for r in wanted.select("bucket").distinct().collect()]
    terms, posts = (index.read(spark, part).where(F.col("bucket").isin(used)) for part in ("terms", "posts"))
    stats = index.read(spark, "stats")
    known = terms.join(checked_queries(wanted), ["bucket", "term"])
    known = known.join(stats, by) if by else known.crossJoin(F.broadcast(stats))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = written(known.select("bucket", *by, "query_id", "term", "average", (idf * F.col("qf")).alias("qw")), "query-weights")
    bounds = posts.where("most_tf IS NOT NULL").select("bucket", *by, "term", "cell", "most_tf", "least_len").join(checked_queries(known), ["bucket", *by, "term"])
    most = F.col("qw") * _weight(F.col("most_tf"), F.col("least_len"), F.col("average"), k1, b)
    return known, posts, written(bounds.groupBy(*by, "query_id", "cell").agg(F.sum(most).alias("bound")), "cell-bounds")


def search(index: Index, queries: DataFrame, k: int, fill: bool = False, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``queries(query_id, question)`` → ``(by, query_id, chunk_id, score, rank)``, the ``k`` best by score, then chunk.

    Exact: no chunk that could be among the best is passed over. A query's repeated terms count each time; scores are
    rounded to 6 places, so that ranks do not hang on the order of a sum. ``fill``: a query that matches fewer than ``k``
    chunks gets those with the smallest ids after them, with score 0.
    """
    by = list(index.by)
    known, posts, bounds = _asked(index, queries, k1, b)
    # Dealt by cell alone, once for both rounds: neither the joins nor the sums below deal them again.
    asked_terms = known.select("bucket", *by, "term").distinct()
    posts = posts.join(checked_queries(asked_terms), ["bucket", *by, "term"], "left_semi").select(*by, "term", "cell", "chunk_id", "tf", "len").repartition(*by, "cell")

    def scored(cells: DataFrame) -> DataFrame:
        asked = cells.groupBy(*by, "cell").agg(F.collect_set("query_id").alias("_asked"))
        hit = posts.join(asked, [*by, "cell"]).join(checked_queries(known.drop("bucket")), [*by, "term"]).where(F.array_contains("_asked", F.col("query_id")))
        weight = F.col("qw") * _weight(F.col("tf"), F.col("len"), F.col("average"), k1, b)
        return hit.groupBy(*by, "query_id", "cell", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score")).drop("cell")

    groups, best = [*by, "query_id"], (F.desc("score"), F.asc("chunk_id"))
    first = top_k(bounds, FIRST, groups, F.desc("bound"), F.asc("cell")).select(*groups, "cell")
    least = top_k(scored(first), k, groups, *best).where(F.col("rank") == k).select(*groups, F.col("score").alias("least"))
    read = bounds.join(least, groups, "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - MARGIN).select(*groups, "cell")
    ranked = top_k(scored(read), k, groups, *best).select(*groups, "chunk_id", "score", "rank")
    spark = queries.sparkSession
    return filled(index.read(spark, "stats"), index.read(spark, "chunks"), by, queries, ranked, k) if fill else ranked


def cells_read(index: Index, queries: DataFrame, k: int) -> tuple[int, int]:
    """``(cells whose bound reaches the threshold, all that hold a term of the query)``, over all queries."""
    by = list(index.by)
    ranked = search(index, queries, k)
    least = ranked.where(F.col("rank") == k).select(*by, "query_id", F.col("score").alias("least"))
    bounds = _asked(index, queries, 1.5, 0.75)[2].join(least, [*by, "query_id"], "left")
    found = bounds.agg(F.count_if(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - MARGIN).alias("a"), F.count("*").alias("b")).first()
    return found.a, found.b


def filled(every: DataFrame, chunks: DataFrame, by: Sequence[str], queries: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``ranked`` with chunks of score 0 behind it, for queries with fewer than ``k`` hits. ``every(by)`` has a row for each
    index, ``chunks(by, chunk_id)`` what is in it."""
    by = list(by)
    groups = [*by, "query_id"]
    ranked = written(ranked, "ranked")
    asked = queries.select("query_id").distinct()
    asked = asked.crossJoin(F.broadcast(every.select(*by))) if by else asked
    short = asked.join(ranked.groupBy(*groups).agg(F.count("*").alias("_n")), groups, "left").where(F.coalesce("_n", F.lit(0)) < k).select(*groups)
    chunks = chunks.distinct()
    # The first k ids of each index, for as many queries as are short of hits.
    firsts = top_k(chunks, k, by, F.asc("chunk_id")).drop("rank") if by else chunks.orderBy("chunk_id").limit(k)
    added = short.join(firsts, by) if by else short.crossJoin(F.broadcast(firsts))
    added = added.join(ranked, [*groups, "chunk_id"], "left_anti").select(*groups, "chunk_id", F.lit(0.0).alias("score"))
    both = ranked.select(*groups, "chunk_id", "score").unionByName(added)
    return top_k(both, k, groups, F.desc("score"), F.asc("chunk_id")).select(*groups, "chunk_id", "score", "rank")

"""Nearest neighbours by inner product over additively quantised vectors.

A vector is approximated by the sum of one word from each of several full-dimensional codebooks. The codebooks are
fitted one after another to what the ones before leave, and then again all together; a vector's words are chosen by beam
search. A query's products with all code words are tabled once, so that a candidate's score is a sum of table entries,
put to scale by stored norms. Codes alone are held against queries; the best of all candidates of a query, a fixed
number whatever the table's size, are then scored again on the original vectors, in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows, cut, drop_cut

#: Vectors that the codebooks are fitted on at most, by a hash of their ids.
FIT_ROWS = 16_384
CODEBOOKS, WORDS, BEAM = 24, 256, 4
#: Distinct vectors that are scored exactly for a query, at every size of the table.
SHORTLIST = 400
#: Distinct vectors of a block, and queries of a block; blocks of queries at least (where there are so many queries).
BLOCK_ROWS, QUERY_ROWS, QUERY_BLOCKS = 16_384, 8_192, 12
#: Queries whose tables are at hand together.
TOGETHER = 64
TOP = 20


@dataclass
class Codebooks:
    """``words``: float32 of shape (codebooks, words, dimensions)."""

    words: np.ndarray

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.words.shape[2]), np.float32)
        for m, book in enumerate(self.words):
            out += book[codes[:, m]]
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Beam search: after each codebook, the ``beam`` best sums of words so far are kept."""
        return np.concatenate([self._encode(x[at : at + 512], beam) for at in range(0, len(x), 512)]) if len(x) else np.zeros((0, len(self.words)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, rows = len(x), np.arange(len(x))
        rest = x[:, None, :].astype(np.float32)  # what each kept sum leaves
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.words:
            # |rest - word|² without the part that no choice changes
            loss = rest @ (-2 * book.T)
            loss += (book**2).sum(1)
            loss += np.einsum("nbd,nbd->nb", rest, rest)[:, :, None]
            loss = loss.reshape(n, -1)
            best = np.zeros((n, min(beam, loss.shape[1])), np.int64)
            for k in range(best.shape[1]):
                best[:, k] = loss.argmin(1)
                loss[rows, best[:, k]] = np.inf
            parent, word = best // len(book), best % len(book)
            rest = rest[rows[:, None], parent] - book[word]
            codes = np.concatenate([codes[rows[:, None], parent], word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0]


def _means(x: np.ndarray, at: np.ndarray, book: np.ndarray) -> None:
    """Set each word of ``book`` to the mean of the rows of ``x`` that ``at`` gives it; words without rows stay."""
    counts = np.bincount(at, minlength=len(book))
    used = np.flatnonzero(counts)
    book[used] = np.add.reduceat(x[np.argsort(at, kind="stable")], np.r_[0, np.cumsum(counts[used])[:-1]]) / counts[used, None]


def fit_codebooks(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 4, seed: int = 5, beam: int = BEAM) -> Codebooks:
    """Each codebook by k-means on what the ones before leave; then, for the beam's choice of words, each again to what
    all the others leave."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, books = x.copy(), []
    for _ in range(codebooks):
        book = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            _means(rest, ((book**2).sum(1) - 2 * rest @ book.T).argmin(1), book)
        rest -= book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
        books.append(book)
    fitted = Codebooks(np.stack(books))
    codes = fitted.encode(x, beam)
    rest = x - fitted.decode(codes)
    for _ in range(2):
        for book, at in zip(fitted.words, codes.T, strict=True):
            own = rest + book[at]
            _means(own, at, book)
            rest = own - book[at]
    return fitted


def usable(vector: Column) -> Column:
    """Not null, no null, NaN or infinite component, and not zero."""
    value = vector.cast("array<double>")
    fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(value, lambda v: v != 0), F.lit(False))


class Best:
    """The ``size`` best candidates of each of some queries, as blocks of candidates come by."""

    def __init__(self, books: Codebooks, queries: np.ndarray, size: int) -> None:
        self.size = size
        self.queries = queries
        self.books = books
        self.score = np.full((len(queries), 0), -np.inf, np.float32)
        self.at = np.zeros((len(queries), 0, 2), np.int64)  # block and place in it

    def add(self, block: int, codes: np.ndarray, scale: np.ndarray) -> None:
        n, kept = len(self.queries), min(self.size, self.score.shape[1] + len(codes))
        score, at = np.empty((n, kept), np.float32), np.empty((n, kept, 2), np.int64)
        for first in range(0, n, TOGETHER):
            rows = slice(first, first + TOGETHER)
            table = np.einsum("qd,mwd->mqw", self.queries[rows].astype(np.float32), self.books.words, optimize=True)
            near = np.zeros((table.shape[1], len(codes)), np.float32)
            for m in range(len(table)):
                near += table[m][:, codes[:, m]]
            near *= scale
            near = np.concatenate([self.score[rows], near], axis=1)
            best = np.argpartition(-near, kept - 1, axis=1)[:, :kept] if kept < near.shape[1] else np.broadcast_to(np.arange(kept), (len(near), kept))
            score[rows] = np.take_along_axis(near, best, 1)
            old = best < self.score.shape[1]
            place = np.where(old, 0, best - self.score.shape[1])
            new = np.stack([np.full_like(place, block), place], axis=2)
            if self.score.shape[1]:
                new = np.where(old[:, :, None], np.take_along_axis(self.at[rows], np.where(old, best, 0)[:, :, None], 1), new)
            at[rows] = new
        self.score, self.at = score, at


def exact_best(query_ids: np.ndarray, queries: np.ndarray, asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, ends: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query_id, vec_id, score)``: of the ``asked`` (query's place, vector's place) the ``top`` best rows of each query,
    its own row left out. A vector stands for several rows: their ids lie between its ``ends``."""
    first = np.r_[0, ends[:-1]]
    out: list[tuple] = []
    for part in np.array_split(asked, max(1, -(-len(asked) // 50_000))):
        score = (queries[part[:, 0]] * vectors[part[:, 1]]).sum(axis=1)
        copies = (ends - first)[part[:, 1]]
        stop = np.cumsum(copies)
        vec = ids[np.repeat(first[part[:, 1]] - (stop - copies), copies) + np.arange(int(copies.sum()))]
        out.append((np.repeat(part[:, 0], copies), vec, np.repeat(score, copies)))
    at, vec, score = (np.concatenate(x) for x in zip(*out, strict=True))
    other = query_ids[at] != vec
    at, vec, score = at[other], vec[other], score[other]
    order = np.lexsort((vec, -score, at))
    at, vec, score = at[order], vec[order], score[order]
    begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
    return query_ids[at[rank < top]], vec[rank < top], score[rank < top]


def nearest(
    embeddings: DataFrame, every: int = 20, top: int = TOP, shortlist: int = SHORTLIST, fit_rows: int = FIT_ROWS, codebooks: int = CODEBOOKS,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` nearest of each row whose id is divisible by ``every``.

    Null, zero and non-finite vectors, vectors with a null component and vectors without an id take no part. Vectors are
    searched among those of their own length, one length after another. Ties go to the smaller id. Rows repeated under one id count once,
    by their first vector in order. Too few candidates give fewer rows; an empty table gives none; other columns are
    not read.

    Scale: rows with one vector are one candidate with the ``top + 1`` smallest of their ids (a query's own may be among
    them), cut before any shuffle. The work is a table lookup for each codebook, query and distinct vector. A task holds
    one block of queries with their best so far, while the blocks of codes come by; the originals, in blocks of bounded
    size, are met once by each block of queries with those asked for. Neither depends on how many blocks there are. The
    codebooks, fitted on at most ``fit_rows`` vectors, are all that is sent to tasks.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect()
    for length, count in sizes:
        own = _nearest_alike(rows.where(F.size("v") == length), length, count, every, top, shortlist, fit_rows, codebooks, block_rows, query_rows)
        found = own if len(sizes) == 1 else found.unionByName(own)
    drop_cut(rows)
    return found


def _nearest_alike(rows: DataFrame, length: int, count: int, every: int, top: int, shortlist: int, fit_rows: int, codebooks: int, block_rows: int, query_rows: int) -> DataFrame:
    """:func:`nearest` over ``count`` rows ``(vec_id, v)`` whose vectors have one length."""
    spark = rows.sparkSession
    per = 1_000_000
    share = min(per, -(-per * fit_rows * 5 // (4 * count)))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(per)) < share).orderBy(F.xxhash64(F.lit(4), "vec_id"), "v").limit(fit_rows).select("v").toPandas()
    sample = sample if len(sample) else rows.limit(1).select("v").toPandas()
    x = np.array(sample.v.tolist())
    del sample
    books = fit_codebooks(x, codebooks, min(WORDS, len(x)))

    # Distinct vectors with the ids that can matter, dealt into blocks.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = rows.withColumn("_n", place).where(F.col("_n") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    blocks = max(1, -(-count // block_rows))
    block_schema = "block int, codes binary, scale binary, vectors binary, ids binary, ends binary"

    def pack(table: pa.Table) -> pa.Table:
        ids = table["ids"].combine_chunks()
        vectors = np.asarray(table["v"].combine_chunks().flatten(), np.float64).reshape(-1, length)
        codes = books.encode(vectors)
        scale = np.linalg.norm(vectors, axis=1) / np.maximum(np.linalg.norm(books.decode(codes), axis=1), 1e-12)
        ends = np.asarray(ids.offsets, np.int64)[1:] - ids.offsets[0].as_py()
        made = (codes.tobytes(), scale.astype(np.float32).tobytes(), vectors.tobytes(), np.asarray(ids.flatten(), np.int64).tobytes(), ends.tobytes())
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32())} | {n: pa.array([x], pa.binary()) for n, x in zip(("codes", "scale", "vectors", "ids", "ends"), made, strict=True)})

    dealt = classes.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    packed = cut(dealt.groupBy("block").applyInArrow(pack, block_schema), "vector-blocks")

    asking = rows.where(F.col("vec_id") % every == 0)
    n_asking = asking.count()
    parts = max(-(-n_asking // query_rows), min(QUERY_BLOCKS, -(-n_asking // TOGETHER)), 1)

    def pack_queries(table: pa.Table) -> pa.Table:
        vectors = np.asarray(table["v"].combine_chunks().flatten(), np.float64)
        return pa.table({"part": table["part"].slice(0, 1), "query_ids": pa.array([np.asarray(table["vec_id"], np.int64).tobytes()], pa.binary()), "queries": pa.array([vectors.tobytes()], pa.binary())})

    queries = asking.withColumn("part", F.pmod(F.xxhash64(F.lit(8), "vec_id"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(pack_queries, "part int, query_ids binary, queries binary")
    queries = cut(queries, "query-blocks")

    ask_schema = pa.schema([("block", pa.int32()), ("query_ids", pa.binary()), ("queries", pa.binary()), ("asked", pa.binary())])

    def shortlists(batches):
        """Rows come sorted by block of queries: for each of these, a row for every block of vectors that it asks."""
        part, best, row = None, None, {}

        def finish():
            query_ids, wanted = np.frombuffer(row["query_ids"], np.int64), np.arange(len(best.at))[:, None]
            pairs = np.stack([np.broadcast_to(wanted, best.at.shape[:2]), best.at[:, :, 0], best.at[:, :, 1]], axis=2).reshape(-1, 3)
            pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
            for one in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 1])) + 1):
                used, at = np.unique(one[:, 0], return_inverse=True)
                made = (int(one[0, 1]), query_ids[used].tobytes(), best.queries[used].tobytes(), np.stack([at, one[:, 2]], axis=1).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, ask_schema, strict=True)], schema=ask_schema)

        for batch in batches:
            for row_now in batch.to_pylist():
                if row_now["part"] != part:
                    if best is not None:
                        yield from finish()
                    part, row = row_now["part"], row_now
                    best = Best(books, np.frombuffer(row["queries"], np.float64).reshape(-1, length), shortlist)
                best.add(row_now["block"], np.frombuffer(row_now["codes"], np.uint8).reshape(-1, len(books.words)), np.frombuffer(row_now["scale"], np.float32))
        if best is not None:
            yield from finish()

    each = packed.select("block", "codes", "scale", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = each.repartition(min(4 * parts, 10_000), "part").join(queries.hint("merge"), "part").sortWithinPartitions("part", "block")
    with arrow_rows(spark, 4):
        asked = cut(met.mapInArrow(shortlists, "block int, query_ids binary, queries binary, asked binary"), "vector-shortlists")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, pairs = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["asked"], np.int32).reshape(-1, 2)
                found = exact_best(
                    query_ids, np.frombuffer(row["queries"], np.float64).reshape(-1, length), pairs, np.frombuffer(row["vectors"], np.float64).reshape(-1, length),
                    np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64), top,
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    with arrow_rows(spark, 2):
        found = cut(asked.join(packed.select("block", "vectors", "ids", "ends").hint("merge"), "block").mapInArrow(score, "query_id long, vec_id long, score double"), "vector-scores")
    for done in (packed, queries, asked):
        drop_cut(done)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Audit of how sources differ in their terms: exact counts of the terms that a count-min sketch lets through.

A first pass counts, in every task, in how many documents of a language each term is, and adds that to a count-min
sketch. The merged sketch never underestimates, so a term below the limit there is below it in truth: the second pass
drops such terms before anything is shuffled. What is left is counted exactly, and joined by term for each pair of
sources.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows, cut, drop_cut, release_memory

#: Rows and counters a row of the sketch: 4 MB, whatever the input.
DEPTH, WIDTH = 4, 1 << 20
#: Counters that are merged and sent together.
BLOCK = 1 << 12
#: Distinct terms of groups that a task holds before it hands its counts on.
HELD = 300_000
#: Parts that a language's counts are dealt to when they meet all its sources.
SALTS = 16
SCALE = 1_000_000_000

#: Terms are runs of letters A-Z, a-z and of all from U+0080 on, which holds byte by byte in UTF-8; only A-Z are lowered.
_KEPT = {*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b in _KEPT else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def counters(lang: str, terms: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The ``DEPTH`` counters of each term of a language, as places in the flat sketch; alike in every process."""
    keys = pd.util.hash_array(np.array([t.decode() for t in terms], object), categorize=False)
    seed = pd.util.hash_array(np.array([lang], object), categorize=False)[0]
    with np.errstate(over="ignore"):
        mixed = (keys ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        step = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32) | np.uint64(1)
        rows = np.arange(DEPTH, dtype=np.uint64)[:, None]
        return ((mixed >> np.uint64(7)) + rows * step) % np.uint64(width) + rows * np.uint64(width)


def merged_sketch(docs: DataFrame, limit: int, width: int = WIDTH) -> np.ndarray:
    """The count-min sketch of document frequencies by language, ``docs(lang, source, text)``; counters stop at 255.

    Every task sends the blocks of its own sketch that hold anything; blocks are summed up as they stream in, so neither
    a task nor the driver holds more than one sketch. ``limit`` must be below 256.
    """
    if not 0 < limit < 256:
        raise ValueError("a counter goes up to 255")
    size = DEPTH * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(size, np.uint8)
        found: dict[str, Counter] = defaultdict(Counter)

        def add() -> None:
            for lang, counted in found.items():
                n = np.minimum(np.fromiter(counted.values(), np.int64, len(counted)), 255)
                places = counters(lang, list(counted), width)
                for row in places:  # terms of one counter add up
                    sums = np.bincount(np.unique(row, return_inverse=True)[1], weights=n)
                    own = np.unique(row)
                    sketch[own] = np.minimum(sketch[own] + sums, 255).astype(np.uint8)
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[lang].update(set(terms_of(text)))
            if sum(map(len, found.values())) > HELD:
                add()
        add()
        blocks = sketch.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(used), 256):
            some = used[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[b].tobytes() for b in some], pa.binary())], names=["block", "counts"])
        release_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(block, np.zeros(BLOCK, np.uint16))
                np.minimum(own + np.frombuffer(raw, np.uint8), 255, out=own)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.astype(np.uint8).tobytes() for x in held.values()], pa.binary())], names=["block", "counts"])

    parts = docs.select("lang", "text").mapInArrow(count, "block int, counts binary")
    written = cut(parts.repartition("block").mapInArrow(merge, "block int, counts binary"), "sketch")
    out = np.zeros(size, np.uint8)
    for r in written.toLocalIterator():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint8)
    drop_cut(written)
    return out


def surviving_counts(spark: SparkSession, docs: DataFrame, sketch: np.ndarray, limit: int) -> DataFrame:
    """``(lang, source, term, n, df)``: exact occurrences and documents of each term that may have ``limit`` documents
    in its language, by the sketch. Terms that cannot are dropped in the tasks, before the shuffle."""
    width = len(sketch) // DEPTH
    shared = spark.sparkContext.broadcast(sketch.tobytes())
    names = ["lang", "source", "term", "n", "df"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint8)
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def passed() -> Iterator[pa.RecordBatch]:
            seen: dict[str, set[bytes]] = defaultdict(set)
            for (lang, _), (n, _) in found.items():
                seen[lang].update(n)
            stay = {}
            for lang, terms in seen.items():
                listed = list(terms)
                may = counts[counters(lang, listed, width)].min(axis=0) >= limit if listed else []
                stay[lang] = {t for t, ok in zip(listed, may, strict=True) if ok}
            for (lang, source), (n, df) in found.items():
                kept = list(stay[lang].intersection(n))
                if kept:
                    same = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(kept), np.int32)), pa.array([x])).dictionary_decode()  # noqa: B023, E731
                    values = [same(lang), same(source), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(list(map(n.__getitem__, kept)), pa.int64()), pa.array(list(map(df.__getitem__, kept)), pa.int64())]
                    yield pa.RecordBatch.from_arrays(values, names=names)
            found.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = terms_of(text)
                n, df = found[lang, source]
                n.update(terms)
                df.update(set(terms))
            if sum(len(n) for n, _ in found.values()) > HELD:
                yield from passed()
        yield from passed()
        release_memory()

    some = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, df long")
    return some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: str, total: str, v: str) -> str:
    """``1 + floor(10⁹ (n + 2) / (total + 2 v))``, exact: the product may be larger than a long."""
    return f"(1 + ({SCALE}BD * CAST({n} + 2 AS DECIMAL(19)) div CAST({total} + 2 * {v} AS DECIMAL(20))))"


def _distance(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def source_divergence(docs: DataFrame, limit: int = 10, top: int = 10, width: int = WIDTH, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language is from every other (``pair``) and
    by which terms it stands out from its language (``term``, the first ``top``).

    Terms are runs of ``[A-Za-z]`` and of all from U+0080 on, A-Z lowered. A language keeps the ``V`` terms that at
    least ``limit`` of its documents have. A group of documents, a (language, source) or a language, gives a kept term with
    ``n`` occurrences there ``p = 1 + floor(10⁹ (n + 2) / (N + 2 V))``, ``N`` being its occurrences of all kept terms; two
    such values are ``floor((p - q)² / (p + q))`` apart, and pairs sum that up over all kept terms. ``term`` has the
    terms that the group has and gives more than its language. Ranks go by value, highest first, then by item.

    Null texts, languages and sources are empty strings; groups without a kept term take part; repeated rows count each;
    an empty table gives an empty result; other columns are not read.

    Scale: the texts are read twice, and tasks hand on counts of their own, without the terms that the sketch excludes;
    a hot source or term is one row a task then. The pair sums go over terms that both sources have, and over the numbers
    of terms alike in count for those that one has; a term meets each pair of its sources once.
    """
    spark = docs.sparkSession
    empty = F.lit("")
    plain = docs.select(F.coalesce(docs[lang_col], empty).alias("lang"), F.coalesce(docs[source_col], empty).alias("source"), docs[text_col].cast("binary").alias("text"))
    with arrow_rows(spark, 1_000):
        sketch = merged_sketch(plain, limit, width)
        counted = cut(surviving_counts(spark, plain, sketch, limit), "term-counts")
    totals = counted.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("df").alias("df")).where(F.col("df") >= limit)
    totals = cut(totals.select("lang", "term", "all"), "kept-terms")
    kept = counted.join(totals, ["lang", "term"])

    langs = totals.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("whole"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    zero = F.lit(0).cast("long")
    groups = plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "v", "whole")])
    # What a term has that the group lacks; a language without kept terms has no such value and nothing to compare.
    groups = cut(groups.withColumn("none", F.expr(f"IF(v = 0, 0L, {_share('0', 'total', 'greatest(v, 1)')})")), "term-groups")
    kept = kept.join(groups.select("lang", "source", "total", "v", "whole"), ["lang", "source"])
    kept = cut(kept.select("lang", "source", "term", "n", F.expr(_share("n", "total", "v")).alias("p"), F.expr(_share("`all`", "whole", "v")).alias("q")), "term-shares")

    first = kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_distance("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    sides = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    pairs = groups.select("lang", "source", "terms", "v", "none").join(groups.select("lang", F.col("source").alias("other"), F.col("terms").alias("other_terms"), F.col("none").alias("other_none")), "lang").where("source < other")
    base = pairs.select("lang", "source", "other", F.expr(f"IF(v = 0, 0L, (v - terms - other_terms) * {_distance('none', 'greatest(other_none, 1)')})").alias("value"))
    # Terms that one source has, as if the other had none: by how many terms have which share.
    alike = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).withColumn("_salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)))
    dealt = sides.withColumn("_salt", F.explode(F.sequence(zero, F.lit(SALTS - 1).cast("long"))))
    single = alike.join(dealt, ["lang", "_salt"]).where("source <> other")
    single = single.select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), F.expr(f"k * {_distance('p', 'other_none')}").alias("value"))
    # And what the terms of both change in that.
    mine = kept.join(groups.select("lang", "source", "none"), ["lang", "source"]).select("lang", "term", "source", "p", "none")
    both = mine.join(mine.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("none").alias("other_none")), ["lang", "term"]).where("source < other")
    change = f"{_distance('p', 'r')} - {_distance('p', 'other_none')} - {_distance('none', 'r')} + {_distance('none', 'other_none')}"
    both = both.groupBy("lang", "source", "other").agg(F.sum(F.expr(change)).alias("value"))
    summed = base.unionByName(single.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))).unionByName(both)
    summed = cut(summed.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")), "source-pairs")
    ends = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("source").alias("b"))))
    each = summed.select("lang", "value", ends.alias("_e")).select("lang", F.col("_e.a").alias("source"), F.lit("pair").alias("part"), F.col("_e.b").alias("item"), "value")
    each = each.withColumn("rank", F.row_number().over(order))
    drop_cut(counted), drop_cut(totals)
    return each.unionByName(first).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def divergence_sql(limit: int = 10, top: int = 10) -> str:
    """The same as DuckDB SQL, over every kept term of every group."""
    terms = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    share = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + 2)) // ({total} + 2 * v))::BIGINT"
    apart = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {terms} AS ts FROM documents),
t AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {limit}),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS whole FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gs AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS MATERIALIZED (SELECT gs.lang, gs.source, kept.term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 'total')} AS p, {share('kept.n', 'whole')} AS q
  FROM gs JOIN langs ON gs.lang = langs.lang JOIN kept ON kept.lang = gs.lang LEFT JOIN counted c ON c.lang = gs.lang AND c.source = gs.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum({apart('a.p', 'b.p')})::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, {apart('p', 'q')}::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
QUALIFY part = 'pair' OR rank <= {top}"""

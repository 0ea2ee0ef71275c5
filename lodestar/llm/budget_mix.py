"""Mixing sources to target weights by fitting each source's budget as a subset sum over exact lengths.

The documents are counted by exact length. A source first gives its whole size as often as its target holds it; of what
remains, every length gives its proportional share, rounded by seed, and a bounded-knapsack dynamic programme over the
lengths' left counts fits the rest to the word. Which documents of a length are taken is decided by a seeded hash. So
long and short documents are taken at one rate.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut, drop_cut, n_words, source_key

WEIGHTS = (5, 2, 1)
#: Offsets of which the best rounds the shares of a source's lengths.
OFFSETS = 64
#: Documents that make room for the programme.
BACK = 16


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to ``budget``, or as near below it as
    they can.

    Every length gives its proportional share. Shares are rounded by one offset along the lengths in order, so neighbours
    make up for each other and long and short ones are taken at one rate; of ``OFFSETS`` seeded offsets the one that
    leaves the fewest words open holds. Of what is taken, ``BACK`` documents, drawn evenly by the seed, go back (more while
    the sum is above the budget), so that documents of any length fit into what is open; the open words are then fitted
    by a bounded knapsack, lengths in seeded order, counts split into
    powers of two, with the first item that reaches a sum kept for walking back. Its memory is that of the open words,
    whatever the number of documents.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    sized = np.where(lengths > 0, counts, 0)
    total = int((lengths * sized).sum())
    if total == 0 or budget <= 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    rng = np.random.default_rng(seed)
    order = np.argsort(lengths, kind="stable")
    due = np.cumsum(sized[order]) * (budget / total)
    tries = []
    for offset in rng.random(OFFSETS):
        take = np.zeros_like(counts)
        take[order] = np.minimum(np.diff(np.floor(due + offset), prepend=0).astype(np.int64), sized[order])
        open_ = budget - int((lengths * take).sum())
        tries.append((open_ < 0, abs(open_), open_, offset, take))
    _, _, open_, _, take = min(tries, key=lambda x: x[:4])
    back = 0
    while open_ < 0 or (back < BACK and 4 * back < take.sum()):
        back += 1
        i = int(np.searchsorted(np.cumsum(take), rng.integers(int(take.sum())), side="right"))
        take[i] -= 1
        open_ += int(lengths[i])
    items: list[tuple[int, int, int]] = []  # (weight, index of its length, number of documents)
    first = np.full(open_ + 1, -1, np.int32)
    reached = np.zeros(open_ + 1, bool)
    reached[0] = True
    left = sized - take
    fits = np.flatnonzero((left > 0) & (lengths <= open_))
    # Lengths with many documents come early as often as their documents would.
    for i in fits[np.argsort(rng.exponential(size=len(fits)) / left[fits], kind="stable")].tolist():
        more, step = min(int(left[i]), open_ // int(lengths[i])), 1
        while more > 0 and not reached[open_]:
            n = min(step, more)
            weight = n * int(lengths[i])
            new = np.flatnonzero(reached[: open_ + 1 - weight]) + weight if weight <= open_ else np.zeros(0, np.int64)
            new = new[~reached[new]]
            first[new] = len(items)
            reached[new] = True
            items.append((weight, i, n))
            more, step = more - n, step * 2
        if reached[open_]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        weight, i, n = items[first[at]]
        take[i] += n
        at -= weight
    return take


def mix_sources(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    share: float = 1.5,
    most: int = 2,
    weights: Sequence[int] = WEIGHTS,
    seed: int = 7,
    buckets: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and ``size, source_size, target, taken, copies``.

    Sources in order of code point, null last, weigh ``weights``, repeating. They share ``share`` times all words; a
    target stops at ``most`` times its source's words and what is over goes to the others by weight. ``copies`` is how
    often the mix takes the row (0 to ``most``), ``taken`` the words of that.

    Null texts and texts without words have size 0 and are taken 0 times; a null source is a source of its own.
    Repeated rows count each; among rows alike in id and text it makes no difference which is taken. An empty table
    gives an empty result. Columns of ``docs`` that are named like a result, and not in ``keep``, are not read.

    Scale: the rows are read twice and shuffled once, by (source, length, hash bucket), so a hot source, or a third of
    the documents in one length, is dealt over ``buckets`` groups. The planning tables hold a row for each (source,
    length, bucket) at most; a task of the programme holds one source's distinct lengths, whose number is below the
    square root of twice its words.
    """
    base = docs.select(
        *[docs[c].alias(f"_keep_{c}") for c in keep],
        n_words(docs[text_col]).alias("size"),
        source_key(docs[source_col]).alias("_source"),
        F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]).alias("_hash"),
    ).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    counted = cut(base.groupBy("_source", "size", "_bucket").agg(F.count("*").alias("n")), "mix-lengths")

    lengths = counted.groupBy("_source", "size").agg(F.sum("n").alias("n"))
    # One row for each source from here: names, weights and targets.
    by_name = Window.orderBy("_source")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = lengths.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    sources = sources.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fills_at", "_source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
    sources = sources.withColumn("level", level).withColumn("full", F.col("level") >= F.col("fills_at"))
    line = F.min(F.when(~F.col("full"), F.struct("fills_at", "_source", "level"))).over(every)["level"]
    sources = sources.withColumn("target", F.least("cap", F.when(F.col("full"), F.col("cap")).otherwise(line * F.col("weight"))))
    sources = sources.select("_source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("rounds"))
    sources = cut(sources, "mix-targets")

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("size")
        first = rows.slice(0, 1).to_pylist()[0]
        budget = round(first["target"] - first["rounds"] * first["source_size"])
        extra = fit_lengths(rows["size"].to_numpy(), rows["n"].to_numpy(), int(budget), zlib.crc32(f"{seed}:{first['_source']}".encode()))
        return pa.table({"_source": rows["_source"], "size": rows["size"], "extra": pa.array(extra, pa.int64())})

    extra = lengths.join(sources, "_source").groupBy("_source").applyInArrow(fit, "_source string, size long, extra long")
    earlier = Window.partitionBy("_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = counted.join(extra, ["_source", "size"]).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    plan = plan.withColumn("here", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before")))).join(sources, "_source")
    plan = cut(plan.select("_source", "size", "_bucket", "here", "source_size", "target", "rounds"), "mix-plan")
    drop_cut(counted), drop_cut(sources)

    keys = ["_source", "size", "_bucket"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", f"_keep_{keep[0]}"))
    out = base.join(plan, keys).withColumn("copies", F.when(F.col("size") > 0, F.col("rounds") + (place <= F.col("here")).cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, whatever their names: each row as often as it is taken."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*at.values())
    picked = mix_sources(plain, keep=list(at.values()), id_col=at[id_col], text_col=at[text_col], source_col=at[source_col], **options)
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return picked.where("copies > 0").withColumn("_time", times).select(*[F.col(v).alias(k) for k, v in at.items()])

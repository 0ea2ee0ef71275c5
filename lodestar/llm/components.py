"""Connected components of an edge table by alternating stars, in logarithmically many rounds of small shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, drop_cut


class Forest:
    """Union-find over integers; the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            low, high = min(a, b), max(a, b)
            self.up[high] = low
        return a != b


def _local_stars(batches):
    """Edges of a partition as stars around the smallest node, a bounded number at a time."""
    def stars(us, vs):
        forest = Forest()
        for a, b in zip(us, vs, strict=True):
            forest.join(a, b)
        nodes = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["u", "v"])

    us, vs = [], []
    for batch in batches:
        us += batch.column(0).to_pylist()
        vs += batch.column(1).to_pylist()
        if len(us) > 500_000:
            yield stars(us, vs)
            us, vs = [], []
    if us:
        yield stars(us, vs)


#: Parts that a node's edges are dealt to, so that a hub is no single task.
SALTS = 32


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with ``m``, the smallest ``v`` of their ``u``.

    The smallest of each part comes first, then that of the node, which goes back to its few parts; the edges themselves
    are only joined part by part.
    """
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "_salt").agg(F.min("v").alias("m"))
    whole = parts.groupBy("u").agg(F.min("m").alias("m"))
    return salted.join(parts.select("u", "_salt").join(whole, "u"), ["u", "_salt"]).select("u", "v", "m")


def _rounds(edges: DataFrame) -> DataFrame:
    """One large star and one small star; edges run from the larger to the smaller node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both).withColumn("m", F.least("m", "u"))
    large = near.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _with_least(large)
    # Each node but the smallest is tied to it, the star's middle too.
    return small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` → ``(node, component)``, the smallest node of each component as its name.

    Nodes without an edge have no row. Loops and repeated edges are allowed; an empty table gives an empty result.
    Partitions first contract what they hold to stars (bounded memory); alternating stars then finish in about
    log² rounds, each written to the shared folder, so that no lost executor repeats a round.
    """
    now = cut(edges.where("u <> v").select("u", "v").mapInArrow(_local_stars, "u long, v long").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if found.n == 0 or (found.n, found.x) == mark:
            break
        mark = (found.n, found.x)
        then, now = now, cut(_rounds(now), "stars")
        drop_cut(then)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

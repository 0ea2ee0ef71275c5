"""Joins by few keys, whose result is far larger than what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.retrieval import checked_queries
from lodestar.sources.shared import written

#: Rows of a key and a side that one cell holds on average, and the most tasks that cells are dealt to.
ROWS, MOST_TASKS = 4096, 2000


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two tables by a column of one type in both, its pairs dealt to tasks by their number.

    The rows of a key are cut into slices on either side, and a task makes the pairs of two slices, so neither one key
    nor a small input with a large result is one task. Slices go by a hash of the row; so many copies of a row are one slice.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    sizes = written(sizes.select(key, *[F.ceil(F.col(n) / ROWS).cast("int").alias(s) for n, s in (("_l", "_a"), ("_r", "_b"))]), "join-cells")
    cells = sizes.agg(F.sum(F.col("_a").cast("long") * F.col("_b"))).first()[0] or 1
    known, tasks = checked_queries(sizes), min(cells, MOST_TASKS)
    mine = lambda df, slices: F.pmod(F.xxhash64(*df.columns), F.col(slices)).cast("int")
    every = lambda slices: F.explode(F.sequence(F.lit(0), F.col(slices) - 1))
    a = left.join(known, key).select(*left.columns, mine(left, "_a").alias("_i"), every("_b").alias("_j"))
    b = right.join(known, key).select(*right.columns, every("_a").alias("_i"), mine(right, "_b").alias("_j"))
    # A number of partitions that is given is kept, though they hold few bytes.
    cell = [key, "_i", "_j"]
    return a.repartition(tasks, *cell).join(b.repartition(tasks, *cell), cell).drop("_i", "_j")

"""Order at scale: ordinals without one task, exact ranks without sorting groups, digests of sets, seeded shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.shared import written

#: Intervals that one pass cuts a range of values into, and values that are sorted at the end at most.
INTERVALS, SORTED = 256, 1_024
#: Digests below one node of a tree, in hexadecimal digits' worth: 16 children, and about this many leaves.
LEAVES = 256


def with_ordinal(df: DataFrame, order: Sequence[Column | str], name: str = "ordinal") -> DataFrame:
    """``df`` with the place of each row, from 1, in ``order``, which should tell all rows apart.

    The rows are dealt by ranges of ``order`` and sorted within, written with their place in the range, and the ranges'
    sizes are added up: one number for each range is all that meets anywhere. Rows alike in ``order`` stand together, in
    any order among themselves; nulls come first.
    """
    columns = df.columns
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.monotonically_increasing_id().alias("_at"))
    placed = written(placed, "ordered")
    place = F.shiftright("_at", 33)  # the upper bits are the partition, the lower ones count in it
    sizes = placed.groupBy(place.alias("part")).agg(F.count("*").alias("n")).collect()
    before, starts = 0, []
    for part, n in sorted((r.part, r.n) for r in sizes):
        starts.append((part, before))
        before += n
    begins = df.sparkSession.createDataFrame(starts, "part long, before long")
    joined = placed.join(F.broadcast(begins), place == F.col("part"))  # a row for each range
    return joined.select("_row.*", (F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def select_ranks(df: DataFrame, by: Sequence[str], column: str, ranks: Mapping[str, Column]) -> DataFrame:
    """``(by, names of ranks)``: of each group the values at places of its sorted ``column``, exactly.

    A rank is a column over ``n``, the group's number of values, counted from 0; outside the group's places, and of a
    group without values, the value is null. Nulls and NaN are no values.

    Each pass cuts the range of values that holds a rank into ``INTERVALS`` and counts, all groups and ranks at once,
    until the range is one value or has at most ``SORTED`` of them, which alone are sorted. So no task holds a group:
    counts combine before their shuffle, and a group has ``INTERVALS`` of them.
    """
    value = F.col(column).cast("double")
    keys = [f"_b{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], value.alias("v"))
    groups = rows.withColumn("v", F.expr("IF(isnan(v), NULL, v)")).groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    groups = written(groups, "rank-groups")
    rows = rows.where("v IS NOT NULL AND NOT isnan(v)")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), rank.cast("long").alias("rank")) for i, rank in enumerate(ranks.values())]))
    state = groups.where("n > 0").select(*keys, "n", "lo", "hi", wanted.alias("_w")).select(*keys, "_w.t", "_w.rank", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), "lo", "hi").where("rank >= 0 AND rank < inside")
    state = written(state, "rank-ranges")
    done, logs = [], False
    same = lambda a: [rows[k].eqNullSafe(a[k]) for k in keys]
    while True:
        found, small = state.where("lo = hi"), state.where(f"lo < hi AND inside <= {SORTED}")
        done.append(found.select(*keys, "t", F.col("lo").alias("value")))
        near = rows.join(small, [*same(small), rows["v"].between(small["lo"], small["hi"])]).select(*[small[k] for k in keys], "t", "rank", "before", "v")
        picked = near.groupBy(*keys, "t", "rank", "before").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        done.append(picked.select(*keys, "t", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("value")))
        wide = state.where(f"lo < hi AND inside > {SORTED}")
        if wide.limit(1).count() == 0:
            break
        held = rows.join(wide, [*same(wide), rows["v"].between(wide["lo"], wide["hi"])]).select(*[wide[k] for k in keys], "t", "rank", "before", "lo", "hi", "v")
        # Never falling in v, so intervals hold neighbours. Passes go by value and by logarithm in turn: one of them parts
        # values of any spread. Quarters keep the widest range finite.
        x, lo, hi = (f"signum({c}) * log1p(abs({c}))" if logs else f"({c} / 4)" for c in ("v", "lo", "hi"))
        step = f"({INTERVALS} / ({hi} - {lo}))"
        cell = F.expr(f"IF({hi} > {lo} AND {step} < 1e300, least({INTERVALS - 1}, floor(({x} - {lo}) * {step})), IF(v > lo, 1, 0))").cast("int")
        logs = not logs
        cells = held.groupBy(*keys, "t", "rank", "before", cell.alias("cell")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = f"before + coalesce(sum(inside) OVER (PARTITION BY {', '.join([*keys, 't'])} ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        cells = cells.withColumn("before", F.expr(upto)).where("before <= rank AND rank < before + inside")
        state = written(cells.select(*keys, "t", "rank", "before", "inside", "lo", "hi"), "rank-ranges")
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    wide = values.groupBy(*keys).agg(*[F.max(F.when(F.col("t") == i, F.col("value"))).alias(f"_v{i}") for i in range(len(ranks))])
    joined = groups.join(wide, [groups[k].eqNullSafe(wide[k]) for k in keys], "left")
    return joined.select(*[groups[k].alias(b) for b, k in zip(by, keys, strict=True)], *[F.col(f"_v{i}").alias(name) for i, name in enumerate(ranks)])


def set_digest(df: DataFrame, by: Sequence[str], part: Column, digits: int = 64) -> DataFrame:
    """``(by, fingerprint)``: SHA-256 over the multiset of ``part`` in each group, by a tree of digests.

    A string's place in the tree is the beginning of its own SHA-256, as many hexadecimal digits as the number of the
    group's distinct strings asks for, so the tree hangs on the content alone. A leaf is SHA-256 of its strings' digests
    and counts, sorted; a node that of its up to 16 children. No task holds more than a leaf, and what a group is does
    not hang on other groups, partitions or order. Null strings are left out; a group of nothing else has none.
    """
    rows = df.select(*by, F.sha2(part.cast("binary"), 256).alias("d")).where("d IS NOT NULL").groupBy(*by, "d").agg(F.count("*").alias("k"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    depth = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / LEAVES) / F.log(F.lit(16.0)) - 1e-9)).cast("int")
    sizes = written(sizes.select(*[F.col(b).alias(f"_{b}") for b in by], depth.alias("depth")), "digest-depths")
    deepest = sizes.agg(F.max("depth")).first()[0]
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    placed = rows.join(sizes, on) if by else rows.crossJoin(F.broadcast(sizes))  # one row
    node = F.struct("d", F.concat_ws(":", "d", F.col("k").cast("string")).alias("s"))
    joined = lambda nodes: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(nodes)), lambda x: x["s"]), "\n").cast("binary"), 256)
    tree = placed.groupBy(*by, F.expr("substring(d, 1, depth)").alias("prefix")).agg(joined(node).alias("s"))
    for level in range(deepest or 0, 0, -1):
        high, low = tree.where(F.length("prefix") < level), tree.where(F.length("prefix") == level)
        up = low.groupBy(*by, F.expr(f"substring(prefix, 1, {level - 1})").alias("up")).agg(joined(F.struct("prefix", F.concat_ws(":", "prefix", "s").alias("s"))).alias("s"))
        tree = high.select(*by, "prefix", "s").unionByName(up.select(*by, F.col("up").alias("prefix"), "s"))
    return tree.select(*by, F.substring("s", 1, digits).alias("fingerprint"))


def shuffled_place(place: Column, n: int, seed: int, rounds: int = 4, steps: int = 200) -> Column:
    """Where a seeded shuffle of ``n`` rows puts the row at ``place`` (0 to n - 1): a keyed permutation, worked out row by
    row, so a shuffle needs no sort.

    A Feistel network permutes the numbers of twice ``half`` bits; what falls outside ``n`` goes through it again until it
    is inside, which keeps it one to one. Fewer than four times ``n`` numbers are permuted, so one step stays outside with
    less than 3 in 4, and ``steps`` of them in practice never; that would stop the job, not give a wrong place.
    """
    if n < 1:
        return place.cast("long")
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = F.lit((1 << half) - 1).cast("long")

    def permuted(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(mask)
        pair = F.aggregate(
            F.sequence(F.lit(0), F.lit(rounds - 1)),
            F.struct(left.alias("l"), right.alias("r")),
            lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(s["r"], F.lit(seed), k).bitwiseAND(mask)).alias("r")),
            lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]),
        )
        return pair

    walk = lambda a, i: F.when((i > 0) & (a < n), a).otherwise(permuted(a))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), place.cast("long"), walk, lambda a: F.when(a < n, a).otherwise(F.raise_error(F.lit("no place within the table")).cast("long")))
    return out

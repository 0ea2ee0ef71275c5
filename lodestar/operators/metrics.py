"""Evaluation analytics: rates, percentiles, shares, rollups, samples, quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.ordering import select_ranks
from lodestar.operators.retrieval import checked_queries


def percentiles(df: DataFrame, by: Sequence[str], column: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``(by, names)``: of each group the percentiles ``name: (rule, share)``, exact, without sorting a group in one task.

    Rules: ``nearest`` is the value at place ``ceil(share * n)``, counted from 1; ``floor`` that at ``floor(share * n)``,
    counted from 0; ``between`` lies between the two values around ``share * (n - 1)``, as a median does.
    """
    n, ranks = F.col("n"), {}
    for name, (rule, share) in wanted.items():
        if rule == "between":
            ranks |= {f"{name}_low": F.floor(share * (n - 1)), f"{name}_high": F.ceil(share * (n - 1))}
        else:
            ranks[name] = F.floor(share * n) if rule == "floor" else F.greatest(F.ceil(share * n) - 1, F.lit(0))
    counted = df.groupBy(*by).agg(F.count(F.expr(f"IF(isnan({column}), NULL, {column})")).alias("_n"))
    found = select_ranks(df, by, column, ranks)
    if any(rule == "between" for rule, _ in wanted.values()):
        renamed = counted.select(*[F.col(b).alias(f"_{b}") for b in by], "_n")
        found = found.join(renamed, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    value = lambda name, share: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (share * (F.col("_n") - 1) - F.floor(share * (F.col("_n") - 1)))
    return found.select(*by, *[(value(name, share) if rule == "between" else F.col(name)).alias(name) for name, (rule, share) in wanted.items()])


def race_numbers(runs: DataFrame, by: str, passed: str, latency: str, tokens: str, cost: str) -> DataFrame:
    """Pass rate, median latency, tokens and mean cost of each group."""
    rates = runs.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col(passed).cast("double")), 6).alias("pass_rate"), F.sum(tokens).alias("tokens"), F.round(F.avg(cost), 6).alias("cost_mean"),
    )
    at = percentiles(runs, [by], latency, {"p50": ("between", 0.5), "p99": ("nearest", 0.99)})
    joined = rates.join(at.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(by, "n", "pass_rate", F.round("p50", 6).alias("p50"), "tokens", "cost_mean", F.round("p99", 6).alias("p99"))


def overlapping_rollup(cases: DataFrame, mode: Column, flag: Column, flag_name: str, passed: Column) -> DataFrame:
    """Passes of each mode, of flagged cases and of all: groups overlap, so neither rollup nor cube gives them."""
    groups = F.array_compact(F.array(mode, F.when(flag, F.lit(flag_name)), F.lit("ALL")))
    counted = cases.select(F.explode(groups).alias("mode"), passed.alias("_p"))
    return counted.groupBy("mode").agg(F.count("*").alias("n"), F.count_if("_p").alias("passed"), F.round(F.avg(F.col("_p").cast("double")), 6).alias("rate"))


def shares(rows: DataFrame, group: Column, amount: Column, places: int = 1) -> DataFrame:
    """Total and percentage of each group, largest first; with nothing in all, the divisor is 1."""
    totals = rows.groupBy(group.alias("grp")).agg(F.sum(amount).alias("total"))
    whole = totals.agg(F.greatest(F.sum("total"), F.lit(1)).alias("_all"))
    return totals.crossJoin(F.broadcast(whole)).select("grp", "total", F.round(100 * F.col("total") / F.col("_all"), places).alias("pct")).orderBy(F.desc("total"), "grp")


def hash_order(seed: str | int, key: Column) -> Column:
    """An order that a seed fixes and that neither partitions nor input order change."""
    return F.sha2(F.concat(F.lit(str(seed)), key.cast("string")), 256)


def seeded_sample(df: DataFrame, key: str, n: int, seed: str | int) -> DataFrame:
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def cost_usd(calls: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """``calls(model, prompt, completion)`` with ``cost``; an unknown model has the default price per million."""
    joined = calls.join(checked_queries(prices), "model", "left")
    spent = F.col("prompt") * F.coalesce("price_in", F.lit(default[0])) + F.col("completion") * F.coalesce("price_out", F.lit(default[1]))
    return joined.withColumn("cost", spent / 1e6).drop("price_in", "price_out")


def fill_level(sizes: DataFrame, kept: int) -> tuple[int, int]:
    """The highest level ``q`` at which modes ``(_fixed, _n)`` filled to it hold at most ``kept``, and what they hold then.

    A mode holds its fixed cases, then ``q``, then all it has: what all hold is linear between the places where some
    mode starts or stops to follow the level. So slopes and sums over the sorted places give the level at once.
    """
    ends = F.explode(F.array(F.struct(F.col("_fixed").alias("x"), F.lit(1).alias("d")), F.struct(F.col("_n").alias("x"), F.lit(-1).alias("d"))))
    bends = sizes.where("_n > _fixed").select(ends.alias("_e")).groupBy("_e.x").agg(F.sum("_e.d").alias("d"))
    base = sizes.agg(F.coalesce(F.sum("_fixed"), F.lit(0)).alias("held"), F.coalesce(F.max("_n"), F.lit(0)).alias("top")).first()
    # A row for each distinct size, whose number is below the square root of twice the cases.
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sloped = bends.withColumn("slope", F.sum("d").over(upto)).withColumn("to", F.lead("x").over(Window.orderBy("x")))
    grown = (F.col("to") - F.col("x")) * F.col("slope")
    sloped = sloped.withColumn("held", base.held + F.coalesce(F.sum(grown).over(upto.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = sloped.where(F.col("held") <= kept).orderBy(F.desc("x")).limit(1).select("x", "slope", "held").first()
    if at is None:
        return 0, base.held
    more = (kept - at.held) // at.slope if at.slope else base.top - at.x
    return at.x + more, at.held + more * at.slope


def trim_to(cases: DataFrame, mode: str, position: str, kept: int, fixed: Column) -> DataFrame:
    """Drop the last unfixed case of the largest mode until ``kept`` remain: the same as filling modes like vessels.

    All modes are filled to one level (:func:`fill_level`); the cases still missing go to the modes above it that
    appear last, one each. Fixed cases count but never go; a mode never falls below its fixed cases.
    """
    sizes = cases.groupBy(mode).agg(F.count("*").alias("_n"), F.min(position).alias("_first"), F.count_if(fixed).alias("_fixed"))
    level, held = fill_level(sizes, kept)
    above = (F.col("_n") > level) & (F.col("_fixed") <= level)
    more = sizes.where(above).orderBy(F.desc("_first")).limit(max(0, kept - held)).select(F.col(mode).alias("_mode"), F.lit(1).alias("_more"))
    quota = sizes.join(more, F.col(mode).eqNullSafe(F.col("_mode")), "left")
    quota = quota.select(F.col(mode).alias("_of"), (F.greatest("_fixed", F.least("_n", F.lit(level))) + F.coalesce("_more", F.lit(0)) - F.col("_fixed")).alias("_free"))
    place = F.row_number().over(Window.partitionBy(mode, "_is_fixed").orderBy(position))
    placed = cases.withColumn("_is_fixed", fixed).withColumn("_r", place)
    joined = placed.join(quota, placed[mode].eqNullSafe(quota["_of"]))
    return joined.where("_is_fixed OR _r <= _free").select(*[placed[c] for c in cases.columns])


def first_of_distinct(rows: DataFrame, group: str, position: str, n: int) -> DataFrame:
    """The first row of each of the first ``n`` groups, then the earliest others until there are ``n``."""
    own = F.row_number().over(Window.partitionBy(group).orderBy(position))
    ranked = rows.withColumn("_own", own)
    return ranked.orderBy(F.when(F.col("_own") == 1, 0).otherwise(1), position).limit(n).drop("_own")


def one_of_each(rows: DataFrame, side: str, position: str, sides: tuple[str, str]) -> DataFrame:
    """The first row of either side if both exist, else the first two rows."""
    others = [c for c in rows.columns if c not in (side, position)]
    firsts = rows.where(F.col(side).isin(*sides)).groupBy(side).agg(F.min(F.struct(position, *others)).alias("_f")).select(side, "_f.*").select(*rows.columns)
    both = firsts.agg(F.count("*").alias("_sides"))
    picked = firsts.withColumn("_both", F.lit(True)).unionByName(rows.orderBy(position).limit(2).withColumn("_both", F.lit(False)))
    return picked.crossJoin(F.broadcast(both)).where(F.col("_both") == (F.col("_sides") == 2)).select(*rows.columns)  # one row of totals


def is_allowed(tool: Column, allow: Column, deny: Column) -> Column:
    return ~F.array_contains(deny, tool) & (F.array_contains(allow, "*") | F.array_contains(allow, tool))

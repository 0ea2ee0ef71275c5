"""Claim rules over ``orders`` and ``lineitem``: an order is a claim, its lines are the estimate."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import rules as R
from lodestar.operators.sums import subset_sum_size
from lodestar.plans.registry import query


def _claims(t):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum(cents).alias("cents"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'covered' WHEN 'O' THEN 'covered_subject_to_sublimit' WHEN 'P' THEN 'excluded' END"
BASIS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'all_peril' WHEN '2-HIGH' THEN 'hurricane' WHEN '3-MEDIUM' THEN 'none_scheduled_article' WHEN '5-LOW' THEN 'all_peril' ELSE 'other' END"


@query("SELECT o_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS estimate_cents FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def estimates(t):
    """Null, not 0, for an order without lines."""
    return _claims(t).select("o_orderkey", F.col("cents").alias("estimate_cents"))


@query(f"""WITH c AS (SELECT o_orderkey, {STATUS} AS status, {BASIS} AS basis, (SELECT 1) AS one, o_totalprice, CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice) / 10 END AS sublimit, o_custkey,
  (SELECT sum(round(l_extendedprice * 100)::BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey) / 100.0 AS amount FROM orders),
d AS (SELECT *, CASE basis WHEN 'all_peril' THEN 1000.0 WHEN 'hurricane' THEN round(round(o_totalprice) / 50, 2) ELSE 0.0 END AS ded,
  CASE WHEN o_custkey % 50 = 0 THEN 'unknown claim' WHEN status = 'covered_subject_to_sublimit' AND sublimit IS NULL THEN 'sublimit required' WHEN status <> 'excluded' AND basis = 'other' THEN 'unknown basis' END AS error FROM c)
SELECT o_orderkey, CASE WHEN error IS NOT NULL THEN NULL WHEN status = 'excluded' THEN 0.0 WHEN status = 'covered_subject_to_sublimit' AND greatest(0, amount - ded) > sublimit THEN round(sublimit, 2) ELSE round(greatest(0, amount - ded), 2) END::DOUBLE AS payable,
  CASE WHEN error IS NULL AND status <> 'excluded' THEN ded END::DOUBLE AS deductible, error FROM d""")
def payouts(t):
    status = F.when(F.col("o_orderstatus") == "F", "covered").when(F.col("o_orderstatus") == "O", "covered_subject_to_sublimit").when(F.col("o_orderstatus") == "P", "excluded")
    pri = F.col("o_orderpriority")
    basis = F.when(pri.isin("1-URGENT", "5-LOW"), "all_peril").when(pri == "2-HIGH", "hurricane").when(pri == "3-MEDIUM", "none_scheduled_article").otherwise("other")
    sublimit = F.when(F.col("o_orderkey") % 4 != 0, F.round("o_totalprice") / 10)
    out = R.payout(F.col("o_custkey") % 50 != 0, status, F.col("cents") / 100.0, basis, F.lit(1000.0), F.round("o_totalprice"), sublimit)
    return _claims(t).select("o_orderkey", out.alias("_p")).select("o_orderkey", "_p.payable", "_p.deductible", "_p.error")


@query("""WITH l AS (SELECT l_orderkey, list(round(l_extendedprice * 100)::BIGINT ORDER BY l_linenumber, l_partkey, l_extendedprice) AS c FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, (SELECT sum(CASE WHEN (m >> (i - 1)) & 1 = 1 THEN c[i] ELSE 0 END) FROM (SELECT unnest(range(1, len(c) + 1)) AS i)) AS total FROM (SELECT l_orderkey, c, unnest(range((1 << len(c))::BIGINT)) AS m FROM l))
SELECT l_orderkey, count(DISTINCT coalesce(total, 0)) AS n_sums, max(coalesce(total, 0))::BIGINT AS largest FROM s GROUP BY 1""")
def estimate_subset_sums(t):
    """Of every order with lines."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"))
    return lines.select("l_orderkey", subset_sum_size("c").alias("s")).select("l_orderkey", "s.n_sums", "s.largest")


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'decision' END AS a, CASE WHEN (o_orderkey % 7 = 0 AND o_custkey % 2 = 1) OR (o_orderkey % 7 <> 0 AND (o_custkey % 5 = 0 OR o_custkey % 4 > 1)) THEN 'payable' END AS b,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'exclusion' END AS c FROM orders)
SELECT o_orderkey, a IS NULL AND b IS NULL AND c IS NULL AS pass, array_to_string(list_filter([a, b, c], lambda x: x IS NOT NULL), '; ') AS why FROM g""")
def outcome_grades(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    expected = F.when(k % 7 != 0, 100.0)
    payable = F.when(k % 7 == 0, F.when(c % 2 == 1, 5.0)).otherwise(F.when(c % 5 != 0, 100.0 + c % 4))
    cited = F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "E‑17").when(F.col("o_orderpriority") == "2-HIGH", "E-18").otherwise("E-99"))
    g = R.grade(F.when(F.col("o_orderstatus") == "F", "covered").otherwise("other"), payable, cited, F.lit("covered"), expected, F.array(F.array(F.lit("E-17"), F.lit("E-18"))))
    return t.orders.select("o_orderkey", g.alias("g")).select("o_orderkey", "g.pass", "g.why")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'claim_number_echoed' END, CASE WHEN o_orderkey % 5 = 0 THEN 'date_of_loss_parseable' END, CASE WHEN o_custkey % 4 = 0 THEN 'excess_numeric' END,
  CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN 'exclusion_cited_on_denial' END], lambda x: x IS NOT NULL), ',') AS failed FROM orders""")
def summary_assertions(t):
    """Summaries are written from the orders in four spellings; the assertions must find what was left out."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    claim = F.concat(F.lit("CLM-2026-"), F.lpad((k % 100000).cast("string"), 5, "0"))
    shown = F.when(k % 5 == 0, F.lit("an unknown day")).otherwise(
        F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "M/d/yyyy")).when(k % 4 == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "d MMM yyyy"))
    )
    excess = 1000 + c % 10
    summary = F.concat(
        F.lit("Claim "), F.when(k % 3 == 0, "withheld").otherwise(claim), F.lit(", loss on "), shown, F.lit(". "),
        F.when(c % 4 == 0, "No excess is known. ").otherwise(F.when(c % 4 == 1, F.concat(F.lit("Deductible of $"), F.format_number(excess.cast("double"), 0), F.lit(" applies. "))).otherwise(F.concat(F.lit("$"), F.format_number(excess.cast("double"), 0), F.lit(" all-peril deductible. ")))),
        F.when(F.col("o_orderstatus") == "P", F.when(c % 3 == 0, "The claim is denied.").otherwise("The claim is denied under E-17.")).otherwise("Paid in full."),
    )
    failed = R.assertions(summary, claim, day, excess, F.array(F.lit("E-17")))
    return t.orders.select("o_orderkey", F.array_join(failed, ",").alias("failed"))

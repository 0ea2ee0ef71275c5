"""Recorded runs over ``conversations``: a conversation is a run, its turns are laps, the length of a turn its cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import trajectory as T
from lodestar.plans.registry import query

LIMIT = 1500
BUDGET_SQL = f"""b AS (SELECT conv_id, turn, length(text) AS cost, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations)"""


@query(f"WITH {BUDGET_SQL} SELECT conv_id, turn, cost::BIGINT AS cost, before AS spent_before, (before + cost)::BIGINT AS spent, before >= {LIMIT} AS blocked FROM b")
def running_budget(t):
    return T.running_budget(t.conversations, "conv_id", "turn", F.length("text").cast("long"), LIMIT)


@query(f"WITH {BUDGET_SQL} SELECT conv_id, min(CASE WHEN before >= {LIMIT} THEN turn END) AS stopped_at, max(CASE WHEN before < {LIMIT} THEN before + cost END)::BIGINT AS spent FROM b GROUP BY 1")
def budget_stops(t):
    return T.stop_laps(t.conversations, "conv_id", "turn", F.length("text").cast("long"), LIMIT)


#: A turn of each role stands for a step: the system's is the claim, the user's a policy search, the assistant's a payout.
SPEC = ("required_forms", "optional_forms", "payout")


def _runs(t) -> DataFrame:
    role, first = F.col("role"), F.substring("text", 1, 1)
    step = F.when(role == "system", F.array(F.lit("claim"))).when(role == "user", F.when(F.length("text") % 3 == 0, F.array(F.lit("policy:A"), F.lit("policy:B"))).otherwise(F.array(F.lit("policy:A")))).otherwise(F.array(F.lit("payout")))
    call = F.concat(role, F.lit(":"), F.lower(first))
    rows = t.conversations.select("conv_id", F.struct("turn", step.alias("s"), call.alias("c")).alias("x"))
    runs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return runs.select(F.col("conv_id").alias("run_id"), F.lit("C").alias("claim_number"), F.transform("xs", lambda x: x["s"]).alias("tokens"), F.transform("xs", lambda x: x["c"]).alias("calls"), F.size("xs").alias("n"))


def _specs(t) -> DataFrame:
    return t.spark.createDataFrame([("C", ["A"], ["B"], "optional")], "claim_number string, required_forms array<string>, optional_forms array<string>, payout string")


STEPS_SQL = """s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE role WHEN 'system' THEN ['claim'] WHEN 'user' THEN CASE WHEN length(text) % 3 = 0 THEN ['policy:A', 'policy:B'] ELSE ['policy:A'] END ELSE ['payout'] END AS tok, role || ':' || lower(substr(text, 1, 1)) AS call FROM conversations),
r AS (SELECT conv_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT * FROM (VALUES (0, ['claim', 'policy:A', 'payout']), (1, ['claim', 'policy:A']), (2, ['claim', 'policy:A', 'policy:B', 'payout']), (3, ['claim', 'policy:A', 'policy:B']), (4, ['claim', 'policy:B', 'policy:A', 'payout']), (5, ['claim', 'policy:B', 'policy:A'])) v(path_no, path)),
m AS (SELECT conv_id, min(path_no) AS path_no FROM (SELECT r.conv_id, p.path_no, bool_and(list_contains(s.tok, p.path[s.i + 1])) AS fits FROM r JOIN p ON r.n = len(p.path) JOIN s ON s.conv_id = r.conv_id GROUP BY ALL) WHERE fits GROUP BY 1)"""


@query(f"WITH {STEPS_SQL} SELECT r.conv_id AS run_id, array_to_string(p.path, '>') AS matched FROM r LEFT JOIN m USING (conv_id) LEFT JOIN p USING (path_no)")
def matched_paths(t):
    return T.match_runs(_runs(t), _specs(t)).select("run_id", F.array_join("matched", ">").alias("matched"))


@query(f"""WITH {STEPS_SQL},
f AS (SELECT s.conv_id, min(CASE WHEN list_contains(tok, 'payout') THEN i END) AS pay, bool_or(list_contains(tok, 'policy:A')) AS has_a, count(*) <> count(DISTINCT call) AS again, max(turn) AS last FROM s GROUP BY 1),
g AS (SELECT f.*, EXISTS (SELECT 1 FROM s WHERE s.conv_id = f.conv_id AND s.i < f.pay AND list_contains(tok, 'policy:A')) AS a_before FROM f),
q AS (SELECT g.*, m.path_no IS NOT NULL AS matched, n % 2 = 1 AS stopped, NOT has_a AS skipped, pay IS NOT NULL AND NOT a_before AS early,
  EXISTS (SELECT 1 FROM s a WHERE a.conv_id = g.conv_id AND list_contains(a.tok, 'policy:A') AND EXISTS (SELECT 1 FROM s b WHERE b.conv_id = a.conv_id AND b.i < a.i AND list_contains(b.tok, 'policy:A'))
    AND (NOT list_contains(a.tok, 'policy:B') OR EXISTS (SELECT 1 FROM s b WHERE b.conv_id = a.conv_id AND b.i < a.i AND list_contains(b.tok, 'policy:B')))) AS revisit
  FROM g JOIN r USING (conv_id) LEFT JOIN m USING (conv_id)),
z AS (SELECT *, NOT matched AND stopped AND NOT skipped AND NOT early AND NOT again AS lost FROM q)
SELECT conv_id AS run_id, array_to_string(list_filter([CASE WHEN NOT stopped THEN 'stopped_without_answer' END, CASE WHEN skipped THEN 'skipped_required_lookup' END, CASE WHEN early THEN 'payout_before_lookup' END, CASE WHEN again THEN 'repeated_identical_call' END,
  CASE WHEN lost AND revisit THEN 'redundant_lookup' END, CASE WHEN lost AND NOT revisit THEN 'unneeded_detour' END, CASE WHEN conv_id % 5 = 0 THEN 'invalid_argument' END, CASE WHEN conv_id % 3 = 0 THEN 'wrong_outcome' END], lambda x: x IS NOT NULL), ',') AS modes FROM z""")
def failure_modes(t):
    runs = T.match_runs(_runs(t), _specs(t))
    modes = T.failure_modes(F.col("tokens"), F.col("calls"), F.array(F.lit("A")), F.lit("optional"), F.col("n") % 2 == 1, F.lit(False), F.col("matched"), F.col("run_id") % 5 != 0, F.col("run_id") % 3 != 0)
    return runs.select("run_id", F.array_join(modes, ",").alias("modes"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 4 AS r, o_orderkey % 5 AS n, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS ends FROM orders)
SELECT o_orderkey, (ends * sum(factorial(n::INT) / factorial(j::INT) / factorial((n - j)::INT) * factorial((r + j)::INT)))::BIGINT AS n_paths FROM (SELECT *, unnest(range(n + 1)) AS j FROM o) GROUP BY o_orderkey, ends""")
def accepted_path_counts(t):
    """How many paths each order's spec accepts: its customer gives the required forms, its number the optional ones."""
    payout = F.when(F.col("o_orderstatus") == "P", "optional").otherwise("required")
    return t.orders.select("o_orderkey", T.path_count(F.col("o_custkey") % 4, F.col("o_orderkey") % 5, payout).alias("n_paths"))


@query("""SELECT conv_id, min(CASE WHEN role = 'assistant' THEN turn END) AS first_pay, count(*) FILTER (WHERE turn < (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant') OR NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant')) AS steps_before FROM conversations a GROUP BY conv_id""")
def before_first_payout(t):
    first = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return t.conversations.withColumn("first_pay", first).groupBy("conv_id").agg(F.min("first_pay").alias("first_pay"), F.count_if(F.col("first_pay").isNull() | (F.col("turn") < F.col("first_pay"))).alias("steps_before"))


@query("""WITH s AS (SELECT conv_id, turn, lower(substr(text, 1, 1)) AS w FROM conversations) SELECT conv_id, turn, EXISTS (SELECT 1 FROM s b WHERE b.conv_id = s.conv_id AND b.turn < s.turn AND b.w = s.w) AS revisit FROM s""")
def revisits(t):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    s = t.conversations.select("conv_id", "turn", F.lower(F.substring("text", 1, 1)).alias("w"))
    return s.select("conv_id", "turn", F.array_contains(F.collect_set("w").over(order), F.col("w")).alias("revisit"))


@query("SELECT conv_id, count(*) AS n_notes, max(turn) AS last_turn, md5(arg_max(text, turn)) AS last_md5, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def last_notes(t):
    notes = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    last = t.conversations.groupBy("conv_id").agg(notes.alias("n")).withColumn("l", F.try_element_at("n", F.lit(-1)))
    return last.select("conv_id", F.size("n").cast("long").alias("n_notes"), F.col("l.turn").alias("last_turn"), F.md5(F.col("l.text").cast("binary")).alias("last_md5"), F.col("l.role").alias("last_role"))


@query("SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS shown, array_to_string(list(role ORDER BY turn) FILTER (WHERE role <> 'system'), ' ') AS roles FROM conversations GROUP BY 1")
def hidden_notes(t):
    """What a tool shows of a claim: notes of one kind are left out."""
    notes = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("n"))
    shown = F.filter("n", lambda x: x["role"] != "system")
    return notes.select("conv_id", F.size(shown).cast("long").alias("shown"), F.array_join(F.transform(shown, lambda x: x["role"]), " ").alias("roles"))


@query("""WITH c AS (SELECT role, count(*) FILTER (WHERE conv_id % 2 = 0) AS a, count(*) FILTER (WHERE conv_id % 2 = 1) AS b FROM conversations GROUP BY 1)
SELECT role AS mode, a AS n_before, b AS n_after, CASE WHEN a = 0 AND b > 0 THEN 'NEW' WHEN b > a THEN 'worse' WHEN b < a THEN 'better' ELSE 'same' END AS change FROM c""")
def mode_changes(t):
    c = t.conversations.groupBy(F.col("role").alias("mode")).agg(F.count_if(F.col("conv_id") % 2 == 0).alias("n_before"), F.count_if(F.col("conv_id") % 2 == 1).alias("n_after"))
    return c.withColumn("change", T.mode_change(F.col("n_before"), F.col("n_after")))

"""Evaluation analytics over ``events``, ``labels``, ``conversations`` and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.text import handoff_group, is_refusal
from lodestar.operators import metrics as M
from lodestar.operators.joins import spread_join
from lodestar.operators.ordering import shuffled_place, with_ordinal
from lodestar.operators.retrieval import checked_queries
from lodestar.plans.registry import query
from lodestar.sources.paged import read_catalogue
from lodestar.sources.shared import new_folder
from lodestar.sources.snapshots import append_once, create_snapshot, read_snapshot, upsert_snapshot
from lodestar.sources.tables import latest_wins, seeded_choice


@query("""SELECT event_type, count(*) AS n, round(avg((value < 80)::INT), 6) AS pass_rate, round(median(value), 6) AS p50, sum(user_id)::BIGINT AS tokens, round(avg(value), 6) AS cost_mean, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def race_numbers(t):
    return M.race_numbers(t.events.withColumn("ok", F.col("value") < 80), "event_type", "ok", "value", "user_id", "value")


@query("SELECT event_type, round(median(value), 6) AS p50, list_sort(list(value))[floor(0.9 * count(*))::BIGINT + 1] AS p90 FROM events GROUP BY 1")
def latency_percentiles(t):
    at = M.percentiles(t.events, ["event_type"], "value", {"p50": ("between", 0.5), "p90": ("floor", 0.9)})
    return at.select("event_type", F.round("p50", 6).alias("p50"), "p90")


@query("""WITH c AS (SELECT event_type AS mode, user_id % 10 = 0 AS reg, value < 50 AS p FROM events), g AS (SELECT unnest(list_filter([mode, CASE WHEN reg THEN 'regression' END, 'ALL'], lambda x: x IS NOT NULL)) AS mode, p FROM c)
SELECT mode, count(*) AS n, count(*) FILTER (WHERE p) AS passed, round(avg(p::INT), 6) AS rate FROM g GROUP BY mode""")
def pass_rate_rollup(t):
    return M.overlapping_rollup(t.events, F.col("event_type"), F.col("user_id") % 10 == 0, "regression", F.col("value") < 50)


@query("SELECT event_type AS grp, sum(user_id)::BIGINT AS total, round(100.0 * sum(user_id) / (SELECT greatest(sum(user_id), 1) FROM events), 1) AS pct FROM events GROUP BY 1")
def token_shares(t):
    return M.shares(t.events, handoff_group(F.concat("event_type", F.lit(" (lap "), (F.col("event_id") % 3).cast("string"), F.lit(")"))), F.col("user_id"))


@query("SELECT arg_max(event_type, total) AS largest, max(total)::BIGINT AS total FROM (SELECT event_type, sum(user_id) AS total FROM events GROUP BY 1)")
def largest_group(t):
    totals = t.events.groupBy("event_type").agg(F.sum("user_id").alias("total"))
    top = F.max(F.struct("total", "event_type"))
    return totals.agg(top.alias("m")).select(F.col("m.event_type").alias("largest"), "m.total")


@query("SELECT round(sum(user_id) FILTER (WHERE event_type = 'view')::DOUBLE / sum(user_id) FILTER (WHERE event_type = 'click'), 4) AS multiplier FROM events")
def resend_multiplier(t):
    part = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("user_id")))
    return t.events.agg(F.round(part("view") / part("click"), 4).alias("multiplier"))


@query("SELECT count(*) AS n, round(avg((quality = 1 - toxic)::INT), 4) AS agreement, round(avg((quality = 1 - toxic)::INT) FILTER (WHERE doc_id NOT IN (1, 2, 3)), 4) AS agreement_held_out FROM labels")
def judge_agreement(t):
    agree = (F.col("quality") == 1 - F.col("toxic")).cast("double")
    return t.labels.agg(F.count("*").alias("n"), F.round(F.avg(agree), 4).alias("agreement"), F.round(F.avg(F.when(~F.col("doc_id").isin(1, 2, 3), agree)), 4).alias("agreement_held_out"))


@query("""SELECT e.event_type AS model, round(sum((user_id * coalesce(i, 0.5) + (event_id % 1000) * coalesce(o, 1.5)) / 1e6), 6) AS cost FROM events e LEFT JOIN (VALUES ('view', 0.1, 0.4), ('click', 0.2, 0.8)) p(m, i, o) ON p.m = e.event_type GROUP BY 1""")
def model_costs(t):
    prices = t.spark.createDataFrame([("view", 0.1, 0.4), ("click", 0.2, 0.8)], "model string, price_in double, price_out double")
    calls = t.events.select(F.col("event_type").alias("model"), F.col("user_id").alias("prompt"), (F.col("event_id") % 1000).alias("completion"))
    return M.cost_usd(calls, prices, (0.5, 1.5)).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT user_id, sum(event_id % 100)::BIGINT AS tokens, round(greatest(0, sum(value) - sum(CASE WHEN event_type = 'error' THEN value * 2 ELSE 0 END)), 4) AS latency_s FROM events GROUP BY 1")
def ledgers(t):
    throttle = F.sum(F.when(F.col("event_type") == "error", F.col("value") * 2).otherwise(0.0))
    return t.events.groupBy("user_id").agg(F.sum(F.col("event_id") % 100).alias("tokens"), F.round(F.greatest(F.lit(0.0), F.sum("value") - throttle), 4).alias("latency_s"))


@query("""WITH f AS (SELECT * FROM events WHERE event_type <> 'error'), t AS (SELECT count(*) AS n FROM f)
SELECT event_type AS topic, count(*) AS n, round(100.0 * count(*) / greatest((SELECT n FROM t), 1), 1) AS pct, (SELECT count(*) FROM events WHERE event_type = 'error') AS excluded FROM f GROUP BY 1""")
def frame_report(t):
    """The frame is what did not fail; its topics in percent, and how many were left out."""
    frame = t.events.where("event_type <> 'error'")
    excluded = t.events.agg(F.count_if(F.col("event_type") == "error").alias("excluded"))
    topics = M.shares(frame, F.col("event_type"), F.lit(1)).select(F.col("grp").alias("topic"), F.col("total").alias("n"), "pct")
    return topics.crossJoin(F.broadcast(excluded))


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE value > 90 GROUP BY 1")
def excluded_reasons(t):
    return t.events.where("value > 90").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS n_refused, count(*) AS n FROM events")
def refusals(t):
    answer = F.when(F.col("event_type") == "error", F.lit("\n REFUSAL: not in the forms")).otherwise("It is covered.")
    return t.events.agg(F.count_if(is_refusal(answer)).alias("n_refused"), F.count("*").alias("n"))


@query("SELECT event_type AS label, count(*) FILTER (WHERE event_id % 2 = 0) AS n_before, count(*) FILTER (WHERE event_id % 2 = 1) AS n_after FROM events GROUP BY 1")
def tool_counts(t):
    return t.events.groupBy(F.col("event_type").alias("label")).agg(F.count_if(F.col("event_id") % 2 == 0).alias("n_before"), F.count_if(F.col("event_id") % 2 == 1).alias("n_after"))


@query("SELECT sum(p_size + 1)::BIGINT AS changed FROM part")
def changed_lines(t):
    line = F.concat_ws("\t", F.col("p_size").cast("string"), F.lit("1"), "p_name")
    return t.part.agg(F.sum(F.split(line, "\t")[0].cast("long") + F.split(line, "\t")[1].cast("long")).alias("changed"))


@query("""WITH RECURSIVE c AS (SELECT p_partkey, p_type, p_size <= 3 AS fixed, row_number() OVER (PARTITION BY p_type, p_size <= 3 ORDER BY p_partkey) AS r FROM part),
s AS (SELECT p_type, count(*) AS n, min(p_partkey) AS first, count(*) FILTER (WHERE fixed) AS f FROM c GROUP BY 1), k AS (SELECT count(*) * 9 // 20 AS kept FROM part),
l AS (SELECT q, sum(greatest(f, least(n, q))) AS total FROM s, (SELECT unnest(range((SELECT max(n) + 1 FROM s))) AS q) GROUP BY q), best AS (SELECT max(q) AS q, max(total) AS total FROM l, k WHERE total <= kept),
o AS (SELECT p_type, greatest(f, least(n, q)) - f + CASE WHEN n > q AND f <= q AND row_number() OVER (ORDER BY CASE WHEN n > q AND f <= q THEN 0 ELSE 1 END, first DESC) <= kept - total THEN 1 ELSE 0 END AS free FROM s, best, k)
SELECT p_partkey FROM c JOIN o USING (p_type) WHERE fixed OR r <= free""")
def trimmed_cases(t):
    """Nine in twenty parts stay; small ones are fixed."""
    cases = t.part.select("p_partkey", "p_type", "p_size")
    return M.trim_to(cases, "p_type", "p_partkey", cases.count() * 9 // 20, F.col("p_size") <= 3).select("p_partkey")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS own FROM part) SELECT p_partkey, p_brand FROM o ORDER BY CASE WHEN own = 1 THEN 0 ELSE 1 END, p_partkey LIMIT 2""")
def first_failures(t):
    return M.first_of_distinct(t.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", 2)


@query("SELECT min(doc_id) FILTER (WHERE toxic = 1) AS lenient, min(doc_id) FILTER (WHERE toxic = 0) AS strict FROM labels")
def few_shot_pick(t):
    picked = M.one_of_each(t.labels.select("doc_id", "toxic").distinct(), "toxic", "doc_id", (1, 0))
    return picked.agg(F.min(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("lenient"), F.min(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("strict"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS id FROM customer")
def sequential_ids(t):
    return with_ordinal(t.customer.select("c_custkey", "c_name"), ["c_name", "c_custkey"], "id").drop("c_name")


@query("""SELECT event_id, event_type <> 'error' AND (user_id % 4 = 0 OR event_type IN ('view', 'click')) AS allowed FROM events""")
def allowed_calls(t):
    allow = F.when(F.col("user_id") % 4 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("view"), F.lit("click")))
    return t.events.select("event_id", M.is_allowed(F.col("event_type"), allow, F.array(F.lit("error"))).alias("allowed"))


@query("""SELECT coalesce(s.scope, 'default') AS scope, count(*) AS n FROM events e LEFT JOIN (VALUES (sha256('u1'), 'admin'), (sha256('u2'), 'reader')) s(h, scope) ON s.h = sha256('u' || e.user_id) GROUP BY 1""")
def caller_scopes(t):
    scopes = t.spark.createDataFrame([("u1", "admin"), ("u2", "reader")], "token string, scope string").select(F.sha2("token", 256).alias("h"), "scope")
    calls = t.events.select(F.sha2(F.concat(F.lit("u"), F.col("user_id").cast("string")), 256).alias("h"))
    return calls.join(checked_queries(scopes), "h", "left").groupBy(F.coalesce("scope", F.lit("default")).alias("scope")).agg(F.count("*").alias("n"))


@query("""SELECT n_name, count(*) AS n_orders, count(*) FILTER (WHERE o_totalprice > 250000) AS n_large, round(avg((o_totalprice > 250000)::INT), 6) AS rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def joined_runs(t):
    """Runs with their cases and specs: two small dimensions."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    large = F.col("o_totalprice") > 250000
    return joined.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.count_if(large).alias("n_large"), F.round(F.avg(large.cast("double")), 6).alias("rate"))


@query("""SELECT c.conv_id, count(l.doc_id) AS n_labels, coalesce(bool_or(l.toxic = 1), false) AS failed FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN labels l ON l.doc_id = c.conv_id GROUP BY 1""")
def optional_verdicts(t):
    joined = t.conversations.select("conv_id").distinct().join(t.labels, F.col("doc_id") == F.col("conv_id"), "left")
    return joined.groupBy("conv_id").agg(F.count("doc_id").alias("n_labels"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("failed"))


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_size = s_suppkey % 50 + 1 AND p_retailprice > 950")
def argument_references(t):
    """Values against a reference set, by one of 50 keys."""
    asked = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 50 + 1).alias("size"))
    real = t.part.where("p_retailprice > 950").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    return spread_join(asked, real, "size").select("s_suppkey", "p_partkey")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM l WHERE r = 1""")
def latest_by_key(t):
    """An upsert's outcome: of each key the latest row."""
    return latest_wins(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT event_id, ['phone', 'web', 'mail'][(('0x' || substr(md5('5:' || event_id), 1, 8))::BIGINT % 3) + 1] AS channel, true AS once, true AS inside FROM events""")
def synthetic_traffic(t):
    """A channel for each event, and its place in a seeded shuffle, which each place has once."""
    n = t.events.count()
    rows = with_ordinal(t.events.select("event_id"), ["event_id"], "place")
    placed = rows.select("event_id", seeded_choice(5, F.col("event_id"), ["phone", "web", "mail"]).alias("channel"), shuffled_place(F.col("place") - 1, n, 5).alias("place"))
    taken = placed.groupBy("place").agg(F.count("*").alias("n"))
    return placed.join(taken, "place").select("event_id", "channel", (F.col("n") == 1).alias("once"), F.col("place").between(0, n - 1).alias("inside"))


@query("""SELECT user_id % 5 AS grp, min(ts) AS first_ts, count(*) AS n FROM events GROUP BY 1""")
def append_log_report(t):
    """A log of three batches, one of which is sent twice, and what it holds then."""
    folder = new_folder(t.spark, "log")
    rows = t.events.select("event_id", (F.col("user_id") % 5).alias("grp"), "ts", "props")
    for k in (0, 1, 1, 2):
        append_once(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), folder, f"part {k}", ["props"])
    return read_snapshot(t.spark, folder).groupBy("grp").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error'),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error')
SELECT coalesce(e.user_id, l.user_id) AS user_id, coalesce(e.event_id, l.event_id) AS event_id FROM (SELECT * FROM l WHERE r = 1) l FULL JOIN (SELECT * FROM e WHERE r = 1) e ON l.user_id = e.user_id""")
def snapshot_upserts(t):
    """A table of each user's last event, into which the last errors are then put by key."""
    folder, order = new_folder(t.spark, "last-events"), [F.desc("ts"), F.desc("event_id")]
    rows = t.events.select("user_id", "event_id", "ts", "event_type")
    create_snapshot(latest_wins(rows.where("event_type <> 'error'"), ["user_id"], order), folder, ["user_id"])
    upsert_snapshot(rows.where("event_type = 'error'"), folder, order)
    return read_snapshot(t.spark, folder).select("user_id", "event_id")


@query("""SELECT p_brand AS server, p_name AS tool, p_brand || '__' || p_name AS name, (p_partkey % 7)::INT AS page FROM part""")
def paged_tools(t):
    """A brand's parts as a server's tools, recorded in seven pages and listed again by cursor."""
    folder, page = new_folder(t.spark, "catalogue"), F.col("p_partkey") % 7
    tool = F.struct(F.col("p_name").alias("name"), F.lit("").alias("about"))
    found = t.part.select(F.col("p_brand").alias("server"), page.cast("int").alias("page"), tool.alias("tool"))
    brands = [r[0] for r in found.select("server").distinct().orderBy("server").collect()]  # a partition for each
    pages = found.groupBy("server", "page").agg(F.collect_list("tool").alias("tools"))
    every = found.select("server").distinct().select("server", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("page"))
    pages = every.join(pages, ["server", "page"], "left").withColumn("tools", F.coalesce("tools", F.array().cast("array<struct<name: string, about: string>>")))
    cursor = F.when(F.col("page") == 0, "start").otherwise(F.concat(F.lit("c"), F.col("page").cast("string")))
    following = F.when(F.col("page") < 6, F.concat(F.lit("c"), (F.col("page") + 1).cast("string")))
    pages.select("server", cursor.alias("cursor"), "tools", following.alias("next")).write.partitionBy("server", "cursor").json(folder)
    return read_catalogue(t.spark, brands, folder).select("server", "tool", "name", "page")

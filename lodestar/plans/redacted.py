"""Redaction, hashes and logs over ``documents``, ``customer``, ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions.hashing import hmac_pads, paired_hash, pseudonym
from lodestar.operators import redaction as R
from lodestar.operators.metrics import hash_order, seeded_sample
from lodestar.operators.ordering import with_ordinal
from lodestar.operators.roster import redact_by_roster
from lodestar.plans.registry import query

#: The salt of tests and checks; a real one is given by the caller and never written down.
CHECK_SALT = b"check"
INNER, OUTER = hmac_pads(CHECK_SALT)
#: The library's patterns as DuckDB literals.
PATTERN = {kind: pattern.replace("'", "''") for kind, pattern in R.PATTERNS.items()}


def masked_sql(text: str) -> str:
    for kind, pattern in PATTERN.items():
        text = f"regexp_replace({text}, '{pattern}', '[{kind}]', 'g')"
    return text


def count_sql(kind: str) -> str:
    return f"len(regexp_extract_all(text, '{PATTERN[kind]}'))"


TOKEN_SQL = f"'[{{kind}}:' || substr(sha256(from_hex('{OUTER}') || from_hex(sha256(from_hex('{INNER}') || encode(lower(trim({{value}})))))), 1, 6) || ']'"


@query(f"SELECT c_custkey, {TOKEN_SQL.format(kind='NAME', value='c_name')} AS token FROM customer")
def pseudonyms(t):
    return t.customer.select("c_custkey", pseudonym("NAME", F.col("c_name"), CHECK_SALT).alias("token"))


@query(f"SELECT doc_id, md5({masked_sql('text')}) AS masked_md5, {count_sql('EMAIL')}::BIGINT AS n_email FROM documents")
def masked_documents(t):
    text = F.col("text")
    return t.documents.select("doc_id", F.md5(R.masked(text).cast("binary")).alias("masked_md5"), R.kinds(text, ["EMAIL"])["EMAIL"].alias("n_email"))


@query(f"SELECT lang, count(*) AS n, {', '.join(f'coalesce(sum({count_sql(k)}), 0)::BIGINT AS {k.lower()}' for k in PATTERN)} FROM documents GROUP BY lang")
def redaction_counts(t):
    found = R.kinds(F.col("text"))
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(n).alias(k.lower()) for k, n in found.items()])


@query(f"""WITH f AS (SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{PATTERN[k]}') THEN '{k.lower()}' END" for k in R.LEAKS)}], lambda x: x IS NOT NULL), ',') AS leaks FROM documents) SELECT * FROM f WHERE leaks <> ''""")
def leak_check(t):
    found = t.documents.select("doc_id", R.leaks(F.col("text")).alias("_l"))
    return found.where(F.size("_l") > 0).select("doc_id", F.array_join("_l", ",").alias("leaks"))


@query()
def redacted_documents(t):
    """Pseudonyms for identifiers, the customers' names and cued names; what is written passes the leak check, or the
    query fails."""
    done = redact_by_roster(t.documents.select("doc_id", "text"), "text", t.customer.select("c_name"), CHECK_SALT, "r")
    out = done.select("doc_id", "r.text", F.aggregate(F.map_values("r.counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_redacted"))
    return R.refuse_leaks(out, "text")


@query("""SELECT page_id, array_to_string(list_filter(list_distinct(list_transform(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda x: trim(string_split(x, '?')[1]))), lambda x: x <> '').list_sort(), ',') AS cited FROM pages""")
def citations(t):
    """What a page cites: link targets up to a question mark, each once."""
    found = X.citations(F.col("html"), opening='<a href="/', stop='"', bar=r"\?")
    return t.pages.select("page_id", F.array_join(F.array_sort(found), ",").alias("cited"))


@query(f"""WITH c AS (SELECT c_custkey, {TOKEN_SQL.format(kind='CUST', value="'c' || c_custkey")} AS ref FROM customer), o AS (SELECT o_orderkey, {TOKEN_SQL.format(kind='CUST', value="'c' || o_custkey")} AS ref FROM orders)
SELECT c_custkey, count(*) AS n FROM o JOIN c USING (ref) GROUP BY c_custkey""")
def pseudonymised_join(t):
    ref = lambda c: pseudonym("CUST", F.concat(F.lit("c"), F.col(c).cast("string")), CHECK_SALT).alias("ref")
    return t.orders.select(ref("o_custkey")).join(t.customer.select("c_custkey", ref("c_custkey")), "ref").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, sha256(encode(c_name) || from_hex('00') || encode(c_mktsegment)) AS input_sha256 FROM customer")
def input_hashes(t):
    return t.customer.select("c_custkey", paired_hash(F.col("c_name"), F.col("c_mktsegment")).alias("input_sha256"))


@query("SELECT event_id FROM events ORDER BY sha256('7' || event_id), event_id LIMIT 200")
def seeded_sample_ids(t):
    return seeded_sample(t.events.select("event_id"), "event_id", 200, 7)


@query("SELECT l.doc_id, row_number() OVER (ORDER BY sha256('11' || l.doc_id), l.doc_id) AS place FROM (SELECT DISTINCT doc_id FROM labels) l ANTI JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) d ON l.doc_id = d.doc_id")
def label_order(t):
    """A seeded order of what is not labelled yet (here: not toxic)."""
    left = t.labels.select("doc_id").distinct().join(t.labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_anti")
    return with_ordinal(left.withColumn("_h", hash_order(11, F.col("doc_id"))), ["_h", "doc_id"], "place").drop("_h")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unresolved_chunks(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT md5(lower(trim(text))) AS h FROM conversations) c ANTI JOIN (SELECT md5(lower(trim(text))) AS h FROM documents) d ON c.h = d.h")
def resume_remaining(t):
    h = lambda df: df.select(F.md5(F.lower(F.trim("text")).cast("binary")).alias("h"))
    return h(t.conversations).distinct().join(h(t.documents), "h", "left_anti").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN l.doc_id IS NULL THEN 'UNRESOLVED' END, CASE WHEN length(d.text) <> d.n_chars THEN 'TEXT CHANGED' END, CASE WHEN l.quality = 0 THEN 'LOW QUALITY' END], lambda x: x IS NOT NULL), '; ') AS caveats
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def drift_caveats(t):
    joined = t.documents.join(t.labels.withColumn("_known", F.lit(True)), "doc_id", "left")
    flags = X.ordered_flags([("UNRESOLVED", F.col("_known").isNull()), ("TEXT CHANGED", F.length("text") != F.col("n_chars")), ("LOW QUALITY", F.col("quality") == 0)])
    return joined.select("doc_id", F.array_join(flags, "; ").alias("caveats"))


@query("SELECT event_id, CASE WHEN length(props || event_type) > 12 THEN substr(props || event_type, 1, 12) || '...' ELSE props || event_type END AS short FROM events")
def truncated_results(t):
    return t.events.select("event_id", X.truncated(F.concat("props", "event_type"), 12).alias("short"))


@query("SELECT doc_id, md5(substr(regexp_replace(text, '^[^\\n]*\\n', ''), 1, 900)) AS passage_md5 FROM documents")
def passages(t):
    return t.documents.select("doc_id", F.md5(X.passage(F.col("text")).cast("binary")).alias("passage_md5"))


@query("SELECT event_id, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events")
def parsed_answers(t):
    return t.events.select("event_id", X.json_object(F.concat(F.lit("answer: "), "props", F.lit(" done")), "k long")["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'PASS' WHEN event_type = 'click' AND value < 50 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events")
def verdicts(t):
    kind = F.col("event_type")
    said = F.when(kind.isin("purchase", "signup"), F.lit('Reason first. {"verdict": "pass"}')).when((kind == "click") & (F.col("value") < 50), F.lit("I say PASS.")).when(kind == "click", F.lit("PASS or FAIL?")).otherwise(F.lit("no idea"))
    return t.events.select("event_id", X.verdict(said).alias("verdict"))


@query("SELECT event_id, least(round((user_id % 3) * 60 + (event_id % 60) + 1, 6), 120.0)::DOUBLE AS wait_s FROM events")
def suggested_waits(t):
    minutes, seconds = (F.col("user_id") % 3).cast("string"), (F.col("event_id") % 60).cast("string")
    message = F.concat(F.lit("rate limited, try again in "), F.when(F.col("user_id") % 3 > 0, F.concat(minutes, F.lit("m"))).otherwise(""), seconds, F.lit(".0s"))
    return t.events.select("event_id", X.suggested_wait(message).alias("wait_s"))


@query("SELECT p_partkey, 'EXCL-' || upper(p_type) AS reference FROM part")
def normal_references(t):
    raw = F.concat(F.lit("NG-1103:CLAUSE-EXCL"), F.lit(X.NON_BREAKING_HYPHEN), F.upper("p_type"))
    return t.part.select("p_partkey", X.normal_reference(raw).alias("reference"))


@query("SELECT o_orderkey, (o_orderkey % 3 = 0 OR o_orderkey % 3 = 2 AND o_custkey % 10 > 0) AND o_custkey < 100000 AS is_claim, o_custkey % 10000 >= 1000 AND o_orderkey % 2 = 0 AS is_form FROM orders")
def anchored_filter(t):
    """Claim and form numbers, with something before, behind or missing in some."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.concat(F.lit("CLM-2026-"), F.lpad(c.cast("string"), 5, "0"))
    claim = F.when(k % 3 == 0, number).when(k % 3 == 1, F.concat(F.lit("see "), number)).when(c % 10 == 0, F.concat(number, F.lit("0"))).otherwise(number)
    form = F.concat(F.lit("NG-"), (c % 10000).cast("string"), F.when(k % 2 == 0, "").otherwise(" ed. 2"))
    return t.orders.select("o_orderkey", (X.is_claim_number(claim) & (c < 100000)).alias("is_claim"), X.is_form_number(form).alias("is_form"))

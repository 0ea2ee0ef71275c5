"""Chunking over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import chunking as C
from lodestar.operators.ordering import set_digest
from lodestar.plans.registry import query


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS t FROM documents),
w AS (SELECT doc_id, t, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 400 THEN 1 ELSE 1 + ceil((len(t) - 400) / 350.0)::INT END)) AS i FROM t)
SELECT doc_id, i::INT AS chunk_index, format('{}_naive_chunk_{:03d}', doc_id, i) AS chunk_id, len(t[i * 350 + 1 : i * 350 + 400])::INT AS n_tokens, md5(array_to_string(t[i * 350 + 1 : i * 350 + 400], ' ')) AS text_md5 FROM w""")
def naive_windows(t):
    return C.token_windows(t.documents, ["doc_id"]).select("doc_id", "chunk_index", "chunk_id", "n_tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"))


TAGS = "<h1>|<p>|<li>"
SEGMENTS_SQL = f"""seg AS (SELECT page_id, i - 1 AS pos, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT page_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '({TAGS})', chr(1) || '\\1', 'g'), chr(1)) AS l FROM pages)) WHERE regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> ''),
ordered AS (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM seg)"""


def _segments(t):
    return t.pages.select("page_id", F.posexplode(C.segments(F.col("html"), TAGS, line_start=False)).alias("pos", "text"))


@query(f"WITH {SEGMENTS_SQL} SELECT page_id, pos::INT AS pos, CASE WHEN starts_with(text, '<h1>') THEN 'TITLE' WHEN starts_with(text, '<p>') THEN 'PARAGRAPH' WHEN starts_with(text, '<li>') THEN 'ITEM' ELSE 'PREAMBLE' END AS clause_id, length(text)::INT AS n_chars FROM ordered")
def header_segments(t):
    text = F.col("text")
    clause = F.when(text.startswith("<h1>"), "TITLE").when(text.startswith("<p>"), "PARAGRAPH").when(text.startswith("<li>"), "ITEM").otherwise("PREAMBLE")
    return _segments(t).select("page_id", "pos", clause.alias("clause_id"), F.length("text").alias("n_chars"))


@query(f"""WITH {SEGMENTS_SQL}, h AS (SELECT *, sum(CASE WHEN starts_with(text, '<li>') AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS g FROM ordered)
SELECT page_id, (g - 1)::INT AS segment, md5(string_agg(text, chr(10) ORDER BY pos)) AS text_md5 FROM h GROUP BY page_id, g""")
def glued_segments(t):
    glued = C.glue(_segments(t), "page_id", "pos", "text", F.col("text").startswith("<li>"))
    return glued.select("page_id", "segment", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH m AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM conversations)
SELECT conv_id, entry::BIGINT AS entry, max(CASE WHEN role = 'user' THEN turn END) AS code, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, count(*) AS n_lines FROM m WHERE entry > 0 GROUP BY conv_id, entry""")
def folded_rows(t):
    """A user's turn is a coded row, the turns of others run on from it."""
    folded = C.fold_rows(t.conversations, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), F.col("text"))
    return folded.select("conv_id", "entry", "code", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_lines")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10))[1:10], lambda x: contains(x, ':')) AS l FROM documents),
k AS (SELECT doc_id, list_distinct(list_transform(l, lambda x: trim(string_split(x, ':')[1]))) AS ks FROM l)
SELECT doc_id, len(ks)::INT AS n_fields, array_to_string(list_filter(['Form Number', 'Edition Date', 'Policy Line'], lambda r: NOT list_contains(ks, r)), ',') AS missing FROM k""")
def header_parse(t):
    fields = C.header_fields(F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", F.size(fields).alias("n_fields"), F.array_join(C.missing_fields(fields, ("Form Number", "Edition Date", "Policy Line")), ",").alias("missing"))


def tree_sql(rows: str, by: str, digits: int, deepest: int = 3) -> str:
    """The tree of digests over ``rows(by, s)``, for groups whose trees are at most ``deepest`` high."""
    leaf = "sha256(string_agg(d || ':' || k, chr(10) ORDER BY d))"
    steps, last = "", "t"
    for level in range(deepest, 0, -1):
        steps += f""",
t{level} AS (SELECT {by}, prefix, s FROM {last} WHERE length(prefix) < {level}
  UNION ALL SELECT {by}, substr(prefix, 1, {level - 1}), sha256(string_agg(prefix || ':' || s, chr(10) ORDER BY prefix)) FROM {last} WHERE length(prefix) = {level} GROUP BY ALL)"""
        last = f"t{level}"
    return f"""WITH r AS ({rows}), h AS (SELECT {by}, sha256(s) AS d, count(*) AS k FROM r GROUP BY ALL),
z AS (SELECT {by}, greatest(0, ceil(log2(count(*) / 256.0) / 4 - 1e-9))::INT AS depth FROM h GROUP BY ALL),
t AS (SELECT {by}, substr(d, 1, depth) AS prefix, {leaf} AS s FROM h JOIN z USING ({by}) GROUP BY ALL){steps}
SELECT {by}, substr(s, 1, {digits}) AS fingerprint FROM {last}"""


INDEX_SQL = tree_sql("SELECT source, printf('%012d', doc_id) || chr(31) || text || chr(30) AS s FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL", "source", 16)


@query(f"SELECT f.*, n FROM ({INDEX_SQL}) f JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1) USING (source)")
def index_fingerprint(t):
    part = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("\u001f"), "text", F.lit("\u001e"))
    docs = t.documents.where("doc_id IS NOT NULL AND source IS NOT NULL")
    return set_digest(docs, ["source"], part, 16).join(docs.groupBy("source").agg(F.count("*").alias("n")), "source")


@query(f"""SELECT fingerprint FROM ({tree_sql("SELECT DISTINCT 0 AS g, doc_id::VARCHAR || chr(10) AS s FROM labels", "g", 64)})""")
def population_fingerprint(t):
    return set_digest(t.labels.select("doc_id").distinct(), [], F.concat(F.col("doc_id").cast("string"), F.lit("\n")))


@query("SELECT lang AS strategy, count(*) AS n_chunks, count(DISTINCT source) AS n_files, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def ingest_stats(t):
    return t.documents.groupBy(F.col("lang").alias("strategy")).agg(F.count("*").alias("n_chunks"), F.countDistinct("source").alias("n_files"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[A-Z][a-z]+-[0-9]+|[a-z0-9.]+@[a-z0-9.-]+')) AS id FROM documents""")
def distinct_ids(t):
    found = F.regexp_extract_all(F.col("text"), F.lit(r"[A-Z][a-z]+-[0-9]+|[a-z0-9.]+@[a-z0-9.-]+"), F.lit(0))
    return t.documents.select("lang", F.explode(found).alias("id")).distinct()

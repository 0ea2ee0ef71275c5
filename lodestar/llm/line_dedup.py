"""Removal of globally repeated passages: content-defined chunks of lines, compared byte by byte.

Only DataFrame functions run here. A rolling hash runs over the hashes of three lines; where it is 0 modulo ``divisor``,
and was not at the line before, a chunk ends. The boundaries depend on the lines around them alone, so a passage that
moves keeps its inner boundaries. Chunks of several lines that repeat go.

With ``runs``, passages are also looked for at every line, wherever chunks end: the shortest runs of lines that reach
``long_words`` words, forwards from each line and backwards from each. Of a common run of so many words every line is in
one that lies inside the run, so the run is found whole. Runs overlap, so they are compared by SHA-256 instead of being
shuffled as texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, cut, drop_cut, each_part, part_of, parts_seen


@dataclass(frozen=True)
class Chunking:
    """``min_words``: a chunk with fewer words is never removed (two short stock lines are no passage).

    ``runs``: repeated runs of lines with ``long_words`` words go too, whatever chunks they lie in.
    """

    divisor: int = 8
    base: int = 31
    modulus: int = (1 << 31) - 1
    long_words: int = 50
    min_words: int = 12
    runs: bool = False


#: Chunks and whole runs of lines.
WHOLE = Chunking(runs=True)
ROW = ["_k1", "_k2"]


def _chunks(text: str, rule: Chunking) -> str:
    """``array<struct<first, size, words, digest>>`` of the text's chunks, lines counted from 0.

    The lines' counts and hashes, and the lines that end chunks, are bound to lambda variables: wherever the optimizer
    repeats the expression, each of them is still worked out once for a text.
    """
    rolled = f"coalesce(get(ls, i - 2).h, 0L) * {rule.base**2} + coalesce(get(ls, i - 1).h, 0L) * {rule.base} + get(ls, i).h"
    marks = f"transform(sequence(0, size(ls) - 1), i -> pmod(pmod({rolled}, {rule.modulus}), {rule.divisor}) = 0)"
    ends = f"transform(array({marks}), ms -> filter(sequence(0, size(ls) - 1), i -> i = size(ls) - 1 OR (get(ms, i) AND NOT coalesce(get(ms, i - 1), false))))[0]"
    spans = """transform(es, (e, k) -> named_struct('first', IF(k = 0, 0, get(es, k - 1) + 1), 'size', IF(k = 0, e + 1, e - get(es, k - 1))))"""
    chunks = f"""transform({spans}, c -> transform(array(slice(ls, c.first + 1, c.size)), own -> named_struct(
        'first', c.first, 'size', c.size, 'words', aggregate(own, 0, (a, x) -> a + x.n), 'digest', xxhash64(transform(own, x -> x.h))))[0])"""
    return f"transform(array({_hashed(text)}), ls -> transform(array({ends}), es -> {chunks})[0])[0]"


def _hashed(text: str) -> str:
    """``array<struct<n, h>>``: words and hash of each line."""
    return f"""transform(split({text}, '\\n', -1), x -> named_struct('n', regexp_count(x, r'{WORD}'),
        'h', CAST(conv(substring(md5(CAST(x AS BINARY)), 1, 8), 16, 10) AS LONG)))"""


def _runs(text: str, rule: Chunking) -> str:
    """``array<struct<s, e, d, c>>``: first line, last line, digest and "is a chunk" (no) of the shortest runs of ``rule.long_words`` words.

    They begin and end at lines with words, so a run has at most ``long_words`` of these, and each line is in a bounded
    number of runs. A run that is the shortest in both directions is given once.
    """
    most = rule.long_words
    reach = f"aggregate({{}}, named_struct('w', 0, 'k', -1), (a, p) -> IF(a.w >= {most}, a, named_struct('w', a.w + get(ls, p).n, 'k', a.k + 1)))"
    ahead = reach.format(f"slice(ps, k + 1, {most})")
    back = reach.format(f"reverse(slice(ps, greatest(k + 2 - {most}, 1), least({most}, k + 1)))")
    ahead = f"filter(transform(ps, (p, k) -> transform(array({ahead}), r -> named_struct('s', p, 'e', get(ps, k + r.k), 'ok', r.w >= {most}))[0]), r -> r.ok)"
    back = f"filter(transform(ps, (p, k) -> transform(array({back}), r -> named_struct('s', get(ps, k - r.k), 'e', p, 'ok', r.w - get(ls, p).n >= {most}))[0]), r -> r.ok)"
    runs = f"transform(concat({ahead}, {back}), r -> named_struct('s', r.s, 'e', r.e, 'd', xxhash64(transform(slice(ls, r.s + 1, r.e - r.s + 1), x -> x.h)), 'c', false))"
    return f"transform(array({_hashed(text)}), ls -> transform(array(filter(sequence(0, size(ls) - 1), i -> get(ls, i).n > 0)), ps -> {runs})[0])[0]"


LINES = "split(_text, '\\n', -1)"


def chunked(docs: DataFrame, rule: Chunking) -> DataFrame:
    """``docs`` with the ``_chunks`` of its ``_text``."""
    return docs.withColumn("_chunks", F.expr(_chunks("_text", rule)))


def dedup_lines(docs: DataFrame, rule: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with repeated chunks cut out of the text, and ``n_lines, n_chunks,
    n_removed_chunks, n_removed_lines``; a removed chunk is one that has no line left.

    A chunk counts if it has several lines and ``rule.min_words`` words; with ``rule.runs`` the runs of lines count
    beside the chunks, single lines of ``rule.long_words`` words among them. Of the occurrences of such a passage in the whole table the
    first stays, by smallest id, then place; the others go, in the same text too, but for lines that they share with
    the first. Each line that goes stands at an earlier place, so none is lost altogether. Chunks are taken for
    equal if their bytes are, runs if SHA-256 of theirs is: these overlap, and as texts they would be several times what
    repeats. Null texts stay
    null and count no lines; an empty text is one line without words. Rows alike in id and text are one document and
    are rewritten alike; null ids come first. An empty table gives an empty result; columns named like a result are
    replaced.

    Scale: short hashes of passages are counted first, so that only those whose hash repeats are compared. Both counts
    combine before their shuffles and name the parts of a hash or passage that have occurrences; these are joined part
    by part, so a passage in a third of all texts is no hot group in either join. The texts are shuffled twice, by row,
    never by passage; the joins merge at every size, so that a small run costs its share of a large one.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")]
    rows = docs.select(
        *[docs[c].alias(f"_keep_{c}") for c in names],
        docs[id_col].alias("_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("_text"),
        F.xxhash64(docs[id_col], docs[text_col]).alias("_k1"),
        F.hash(docs[text_col], docs[id_col]).alias("_k2"),
    )
    plain = rows.select(*ROW, "_id", "_text")
    eligible = f"c.words >= {rule.min_words} AND c.size > 1"

    # explode_outer: a filter inferred from explode() would work out every text's passages a second time.
    spans = f"transform(filter({_chunks('_text', rule)}, c -> {eligible}), c -> named_struct('s', c.first, 'e', c.first + c.size - 1, 'd', c.digest, 'c', true))"
    spans = f"concat({spans}, {_runs('_text', rule)})" if rule.runs else spans
    found = plain.select(*ROW, F.explode_outer(F.expr(spans)).alias("_c"))
    found = cut(found.where("_c IS NOT NULL").select(*ROW, F.struct("_c.s", "_c.e", "_c.c").alias("at"), F.col("_c.d").alias("digest")), "line-chunks")
    dealt = found.withColumn("_part", part_of(*ROW))
    repeated = dealt.groupBy("digest").agg(F.count("*").alias("n"), parts_seen("_part").alias("_parts")).where("n > 1").select("digest", each_part("_parts").alias("_part"))
    candidates = cut(dealt.join(repeated.hint("merge"), ["digest", "_part"]).groupBy(*ROW).agg(F.collect_set("at").alias("_at")), "line-candidates")

    passage = "transform(array(CAST(array_join(slice(ls, r.s + 1, r.e - r.s + 1), '\\n') AS BINARY)), b -> IF(r.c, b, unhex(sha2(b, 256))))[0]"
    pieces = F.expr(f"transform(array({LINES}), ls -> transform(_at, r -> named_struct('at', r, 'passage', {passage})))[0]")
    texts = plain.join(candidates.hint("merge"), ROW).select(*ROW, "_id", F.explode_outer(pieces).alias("_p"))
    texts = cut(texts.select("_p.passage", F.struct("_id", *ROW, "_p.at.s", "_p.at.e").alias("at")), "line-passages")
    # The first place of each passage goes to the passage's few parts, and its occurrences are joined part by part.
    dealt = texts.withColumn("_part", part_of("at._k1", "at._k2"))
    first = dealt.groupBy("passage").agg(F.min("at").alias("first"), F.max("at").alias("last"), parts_seen("_part").alias("_parts")).where("first <> last")
    first = first.select("passage", "first", each_part("_parts").alias("_part"))
    start = F.expr("IF(at._k1 = first._k1 AND at._k2 = first._k2, greatest(at.s, first.e + 1), at.s)")
    gone = dealt.join(first.hint("merge"), ["passage", "_part"]).where("at <> first").select("at._k1", "at._k2", F.struct(start.alias("s"), F.col("at.e").alias("e")).alias("_r"))
    gone = cut(gone.groupBy(*ROW).agg(F.collect_set("_r").alias("_gone")), "line-removals")
    for done in (found, candidates, texts):
        drop_cut(done)

    out = chunked(rows.join(gone.hint("merge"), ROW, "left"), rule).withColumn("_gone", F.expr("flatten(transform(coalesce(_gone, array()), r -> sequence(r.s, r.e)))"))
    out = out.withColumn("_left", F.expr("array_except(sequence(0, aggregate(_chunks, 0, (a, c) -> a + c.size) - 1), _gone)"))
    left = "transform(array(flatten(transform(_chunks, (c, k) -> array_repeat(k, c.size)))), own -> size(array_distinct(transform(_left, i -> get(own, i)))))[0]"
    kept = F.expr(f"array_join(transform(array({LINES}), ls -> transform(_left, i -> get(ls, i)))[0], '\\n')")
    given = F.col(f"_keep_{text_col}")
    text = F.when(given.isNull() | (F.size("_gone") == 0), given).otherwise(kept)
    none = given.isNull()
    return out.select(
        *[(text if c == text_col else F.col(f"_keep_{c}")).alias(c) for c in names],
        F.when(none, 0).otherwise(F.expr("aggregate(_chunks, 0, (a, c) -> a + c.size)")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("_chunks")).cast("long").alias("n_chunks"),
        F.expr(f"IF(size(_gone) = 0, 0, size(_chunks) - {left})").cast("long").alias("n_removed_chunks"),
        F.expr("aggregate(_chunks, 0, (a, c) -> a + c.size) - size(_left)").cast("long").alias("n_removed_lines"),
    )


def dedup_sql(table: str, id_col: str = "doc_id", text_col: str = "text", columns: str = "", rule: Chunking = Chunking(), prefix: str = "") -> str:
    """The same as a chain of DuckDB common table expressions that ends in ``{prefix}deduped(id, txt, n_…, columns)``.

    ``table`` has unique ids. ``columns``: further columns to hand through, each with a leading comma.
    """
    p = prefix
    word = r"[^\x20\x09-\x0D]+"
    runs = f"""
  UNION
  SELECT a.id, a.i AS s, b.i AS e FROM {p}worded a ASOF JOIN {p}worded b ON a.id = b.id AND a.upto - a.n + {rule.long_words} <= b.upto
  UNION
  SELECT b.id, a.i AS s, b.i AS e FROM {p}worded b ASOF JOIN {p}worded a ON a.id = b.id AND b.upto - {rule.long_words} >= a.upto - a.n"""
    return f"""
{p}base AS (SELECT {id_col} AS id, {text_col} AS txt{columns} FROM {table}),
{p}lines AS MATERIALIZED (
  SELECT id, i, line, len(regexp_extract_all(line, '{word}')) AS n, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (SELECT id, unnest(string_split(coalesce(txt, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(txt, ''), chr(10))))) AS i FROM {p}base)),
{p}worded AS MATERIALIZED (SELECT * FROM (SELECT id, i, n, (sum(n) OVER (PARTITION BY id ORDER BY i))::BIGINT AS upto FROM {p}lines) WHERE n > 0),
{p}marks AS (
  SELECT *, (coalesce(lag(h, 2) OVER w, 0) * {rule.base**2} + coalesce(lag(h) OVER w, 0) * {rule.base} + h) % {rule.modulus} % {rule.divisor} = 0 AS mark
  FROM {p}lines WINDOW w AS (PARTITION BY id ORDER BY i)),
{p}cuts AS (SELECT *, mark AND NOT coalesce(lag(mark) OVER (PARTITION BY id ORDER BY i), false) AS last FROM {p}marks),
{p}numbered AS MATERIALIZED (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM {p}cuts),
{p}spans AS (
  SELECT id, min(i) AS s, max(i) AS e FROM {p}numbered GROUP BY id, k HAVING count(*) > 1 AND sum(n) >= {rule.min_words}{runs if rule.runs else ""}),
{p}passages AS (
  SELECT x.id, x.s, x.e, string_agg(l.line, chr(10) ORDER BY l.i) AS passage FROM {p}spans x JOIN {p}lines l ON l.id = x.id AND l.i BETWEEN x.s AND x.e GROUP BY x.id, x.s, x.e),
{p}placed AS (
  SELECT *, first_value(id) OVER w AS first_id, first_value(e) OVER w AS first_e, row_number() OVER w AS place FROM {p}passages WINDOW w AS (PARTITION BY passage ORDER BY id, s, e)),
{p}gone AS (
  SELECT DISTINCT id, unnest(range(CASE WHEN id = first_id THEN greatest(s, first_e + 1) ELSE s END, e + 1)) AS i FROM {p}placed WHERE place > 1),
{p}left_over AS (SELECT a.id, a.i, a.line, a.k, g.i IS NOT NULL AS gone FROM {p}numbered a LEFT JOIN {p}gone g ON a.id = g.id AND a.i = g.i),
{p}deduped AS (
  SELECT b.id, CASE WHEN b.txt IS NULL THEN NULL ELSE coalesce(m.txt, '') END AS txt, CASE WHEN b.txt IS NULL THEN 0 ELSE m.n_lines END AS n_lines,
    CASE WHEN b.txt IS NULL THEN 0 ELSE m.n_chunks END AS n_chunks, m.n_removed_chunks, m.n_removed_lines{columns}
  FROM {p}base b JOIN (
    SELECT id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS txt, count(*)::BIGINT AS n_lines, count(DISTINCT k)::BIGINT AS n_chunks,
      (count(DISTINCT k) - count(DISTINCT k) FILTER (WHERE NOT gone))::BIGINT AS n_removed_chunks, count(*) FILTER (WHERE gone)::BIGINT AS n_removed_lines
    FROM {p}left_over GROUP BY id) m ON b.id = m.id)"""

"""URL filtering by rules and by what the link graph says of hosts.

Only DataFrame functions run here. Links in the pages' HTML make weighted edges between hosts. Trust is a personalised
PageRank that starts at trusted hosts and follows links; distrust starts at blocked hosts and runs against them, to
those who link there. A url that no rule judges is judged by its host's two values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, drop_cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative link targets; a relative link stays on its host and is no edge between hosts.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Spread:
    """``follow``: the share that is passed on at each step. Steps end when no value has moved by ``still`` of a seed's
    start since the last look, or after ``steps``, when what is left to come is below ``follow ** steps``. A host is blocked when its distrust, in units of what a
    blocked seed starts with, is ``limit`` or more and exceeds its trust, in units of a trusted seed's."""

    follow: float = 0.85
    steps: int = 48
    still: float = 1e-4
    look: int = 4
    limit: float = 0.25


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits_host(host: Column, rule: Rule) -> Column:
    return (host == rule.host) | host.endswith(f".{rule.host}")


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, blocking ones first among equals; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    whens = [F.when(_fits_host(host, r) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*whens) if whens else F.lit(None).cast("struct<rule:string,verdict:string>")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, weight)``: how many pages of a host link to another host."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(pages[html_col], F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    found = pages.select(host_of(pages[url_col]).alias("src"), F.explode_outer(links).alias("dst"))
    return found.where("src <> '' AND dst IS NOT NULL AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, spread: Spread) -> DataFrame:
    """``seeds(host, seed)``, ``edges(src, dst, share)`` → ``(host, rank)``, written.

    A step is one join and one sum over host edges; every ``spread.look`` steps the result is written, so the lineage
    stays short, and held against the one before.
    """
    start = seeds.select("host", (F.col("seed") * (1 - spread.follow)).alias("rank"))
    now, written = start, cut(start, "host-rank")
    for step in range(1, spread.steps + 1):
        sent = edges.join(now, edges["src"] == now["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank") * spread.follow).alias("sent"))
        now = start.join(sent, "host", "full").select("host", (F.coalesce("rank", F.lit(0.0)) + F.coalesce("sent", F.lit(0.0))).alias("rank"))
        if step % spread.look == 0 or step == spread.steps:
            now, before = cut(now, "host-rank"), written
            moved = now.join(before.withColumnRenamed("rank", "was"), "host", "full").agg(F.max(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
            drop_cut(before)
            written = now
            if (moved or 0.0) <= spread.still * (1 - spread.follow):
                break
    return written


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, spread: Spread = Spread(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of each row of ``pages``.

    Blocked seeds are the hosts that a block rule covers whole (its path is ``/``); trusted seeds are hosts that an
    allow rule fits, if they are not blocked seeds. Where no rule judges a url, its host does: blocked when the distrust
    reaches the limit and exceeds the trust, else allowed; an unknown host has neither and is allowed. A null url, or
    one without ``://``, has an empty host and path, fits no rule and is allowed; null HTML has no links; repeated rows
    are judged each; an empty table gives an empty result; other columns are not read.

    Scale: the HTML is read once and leaves only host pairs, summed before they are shuffled; the steps run over host
    edges, not pages. Pages join their host's one row, so a host with a third of all pages can be split.
    """
    edges = cut(host_edges(pages, url_col, html_col), "host-edges")
    marked = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    hosts = marked.select("host").where("host <> ''").distinct().unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    host = F.col("host")
    blocked = _any([_fits_host(host, r) for r in rules if r.verdict == "block" and r.path == "/"])
    trusted = _any([_fits_host(host, r) for r in rules if r.verdict == "allow"]) & ~blocked
    hosts = cut(hosts.select("host", trusted.cast("double").alias("trusted"), blocked.cast("double").alias("blocked")), "hosts")
    given = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    taken = edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("total")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("total")).alias("share"))
    unit = 1 - spread.follow  # seeds start with 1 each, so a rank is in units of a seed's start after this division
    trust = propagate(hosts.where("trusted > 0").select("host", F.col("trusted").alias("seed")), cut(given, "links-out"), spread)
    distrust = propagate(hosts.where("blocked > 0").select("host", F.col("blocked").alias("seed")), cut(taken, "links-in"), spread)
    ranked = trust.select("host", (F.col("rank") / unit).alias("trust")).join(distrust.select("host", (F.col("rank") / unit).alias("distrust")), "host", "full")
    ranked = cut(ranked.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "host-values")
    out = marked.join(ranked, "host", "left").withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    bad = F.coalesce((F.col("distrust") >= spread.limit) & (F.col("distrust") > F.col("trust")), F.lit(False))
    return out.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def filter_sql(rules: Sequence[Rule] = RULES, spread: Spread = Spread()) -> str:
    """The same for DuckDB over ``pages``, the steps written out one by one."""
    link = LINK.replace("'", "''")
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}')"
    any_of = lambda tests: " OR ".join(tests) or "false"
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in ordered) + " END"
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    blocked = any_of([fits(r) for r in rules if r.verdict == "block" and r.path == "/"])
    trusted = any_of([fits(r) for r in rules if r.verdict == "allow"])
    parts = [
        f"marked AS MATERIALIZED (SELECT page_id, {lower % '''coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')'''} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages)",
        f"found AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda h: {lower % 'h'}))) AS dst FROM marked) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
        "edges AS MATERIALIZED (SELECT * FROM found)",
        f"hosts AS MATERIALIZED (SELECT host, ({blocked}) AS blocked, ({trusted}) AND NOT ({blocked}) AS trusted FROM (SELECT host FROM marked WHERE host <> '' UNION SELECT src FROM edges UNION SELECT dst FROM edges))",
        "given AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges)",
        "taken AS MATERIALIZED (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS share FROM edges)",
    ]
    for name, seed, links in (("t", "trusted", "given"), ("d", "blocked", "taken")):
        parts.append(f"{name}0 AS MATERIALIZED (SELECT host, {seed}::INT::DOUBLE AS rank FROM hosts)")
        for k in range(1, spread.steps + 1):
            parts.append(
                f"{name}{k} AS MATERIALIZED (SELECT h.host, h.rank + coalesce(s.sent, 0) AS rank FROM {name}0 h LEFT JOIN (SELECT l.dst AS host, sum(l.share * r.rank * {spread.follow}) AS sent FROM {links} l JOIN {name}{k - 1} r ON l.src = r.host GROUP BY 1) s ON h.host = s.host)"
            )
    last = spread.steps
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT m.page_id, m.host, m.path, {case(lambda r: r.text)} AS rule,
  coalesce({case(lambda r: r.verdict)}, CASE WHEN d.rank >= {spread.limit} AND d.rank > t.rank THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT page_id, host, path FROM marked) m LEFT JOIN t{last} t USING (host) LEFT JOIN d{last} d USING (host)"""
    )

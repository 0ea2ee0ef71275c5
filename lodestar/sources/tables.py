"""Reading and writing: text forms, JSON lines, catalogues, checked appends, upserts, synthetic traffic."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.chunking import header_fields, missing_fields
from lodestar.operators.redaction import LEAKS, leaks

REQUIRED = ("Form Number", "Edition Date", "Policy Line")
CLAIM = """claim_number string, policy_number string, claimant_name string, status string, date_of_loss string, reported_date string,
    forms array<string>, coverage_a_limit bigint, all_peril_deductible bigint, fnol_description string,
    estimate_lines array<struct<item: string, amount: double>>, adjuster_notes array<struct<date: string, author: string, text: string>>,
    scheduled_articles array<struct<item_no: int, description: string, agreed_value: double>>"""


def read_forms(spark: SparkSession, folder: str, required: Sequence[str] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """``(forms, skipped)``: each text file with its header fields, and those that lack some, with what they lack."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    parsed = files.withColumn("_h", header_fields(F.col("text"))).withColumn("missing", missing_fields(F.col("_h"), required))
    names = {k: k.lower().replace(" ", "_") for k in required}
    forms = parsed.where(F.size("missing") == 0).select("source_file", *[F.col("_h")[k].alias(v) for k, v in names.items()], "text")
    return forms, parsed.where(F.size("missing") > 0).select("source_file", "missing")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are none, fields that are absent are null."""
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_claims(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Claims of several files under one schema; of a claim that is in several, the last file's counts."""
    out = None
    for k, path in enumerate(paths):
        rows = read_json_lines(spark, path, CLAIM).withColumn("_file", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return latest_wins(out, ["claim_number"], [F.desc("_file")]).drop("_file")


def lookup(df: DataFrame, key: str, values: Sequence[Any]) -> DataFrame:
    """Rows whose key, stripped and in capitals, is one of a few values."""
    return df.where(F.upper(F.trim(F.col(key))).isin([str(v).strip().upper() for v in values]))


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_wins(both, keys, [F.desc("_new")]).drop("_new")


def replace_failed(rows: DataFrame, again: DataFrame, key: str, failed: Column) -> DataFrame:
    """Failed rows replaced by their second try, if there is one; all others as they are."""
    columns = [c for c in rows.columns if c != key]
    second = again.select(key, *[F.col(c).alias(f"_{c}") for c in columns]).withColumn("_again", F.lit(True))
    joined = rows.withColumn("_failed", failed).join(second, key, "left")
    use = F.col("_failed") & F.col("_again").isNotNull()
    return joined.select(key, *[F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


class Refused(ValueError):
    """Something would have leaked; nothing was written."""


def append_checked(rows: DataFrame, path: str, texts: Sequence[str], kinds: Sequence[str] = LEAKS) -> None:
    """Append JSON lines, or nothing at all where an identifier is left in a text of any row."""
    found = F.array_distinct(F.flatten(F.array(*[leaks(F.col(c), kinds) for c in texts])))
    bad = rows.select(F.explode(found).alias("kind")).groupBy("kind").count().collect()
    if bad:
        raise Refused("; ".join(f"{r['kind']}: {r['count']} rows" for r in sorted(bad, key=lambda r: r["kind"])))
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def markdown(rows: DataFrame, most: int = 1_000) -> str:
    """A small result as a Markdown table."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write them instead")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()])


def catalogue(config: DataFrame, column: str = "servers") -> DataFrame:
    """``config(servers: map<string, struct<tools: array<string>, …>>)`` → ``(server, tool, name)``, tools as
    ``server__tool``."""
    rows = config.select(F.explode(column).alias("server", "_spec")).select("server", F.explode("_spec.tools").alias("tool"))
    return rows.withColumn("name", F.concat_ws("__", "server", "tool"))


def form_listing(forms: DataFrame) -> DataFrame:
    """All forms and titles in one string, as an error message quotes them."""
    return forms.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "form_number", "title"))), "; ").alias("listing"))


def seeded_choice(seed: int, key: Column, values: Sequence[str]) -> Column:
    """One of a few values for each key, by a hash: the same in every run and engine."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def render_hits(hits: DataFrame) -> DataFrame:
    """``hits(query_id, rank, chunk_id, score, text)`` as one context block for each query."""
    one = F.format_string("[%d] %s (%.4f)\n%s", "rank", F.col("chunk_id").cast("string"), F.col("score").cast("double"), "text")
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("_b")))).alias("_rows"))
    return rows.select("query_id", F.array_join(F.transform("_rows", lambda r: r["_b"]), "\n\n").alias("context"))

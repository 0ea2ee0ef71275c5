"""Rows as texts that people or models read: claim files, traces, contexts and hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value.cast("double"), 2))


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value.cast("string")))


def _bullets(title: str, items: Column, one) -> Column:
    return F.when(F.size(F.coalesce(items, F.array())) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(items, one), "\n")))


def claim_file(scalars: dict[str, Column], lines: Column, notes: Column) -> Column:
    """Labelled scalars, estimate lines (``item, amount``) and notes (``date, author, text``); what is null or empty is
    left out."""
    parts = [_line(label, value) for label, value in scalars.items()]
    parts.append(_bullets("Estimate", lines, lambda x: F.concat(F.lit("- "), x["item"], F.lit(": "), _money(x["amount"]))))
    parts.append(_bullets("Notes", notes, lambda x: F.concat(F.lit("- "), x["date"], F.lit(" "), x["author"], F.lit(": "), x["text"])))
    return F.concat_ws("\n", *parts)


def trace_text(question: Column, chunk_ids: Column, answer: Column, error: Column) -> Column:
    """A trace: the question, what was retrieved, and the answer, or the error in its place."""
    found = F.when(F.size(F.coalesce(chunk_ids, F.array())) > 0, F.array_join(chunk_ids, ", ")).otherwise("nothing")
    return F.concat_ws("\n", F.concat(F.lit("Q: "), question), F.concat(F.lit("Retrieved: "), found), F.coalesce(F.concat(F.lit("Error: "), error), F.concat(F.lit("A: "), answer), F.lit("A:")))


def context_block(hits: DataFrame) -> DataFrame:
    """``hits(query_id, rank, chunk_id, clause_id, text)`` → the sources of a prompt, numbered by rank."""
    one = F.concat(F.lit("[SOURCE: "), F.col("chunk_id"), F.lit(" | "), F.coalesce("clause_id", F.lit("N/A")), F.lit("]\n"), F.col("text"))
    return _joined(hits, one, "\n\n", "context")


def hit_lines(hits: DataFrame) -> DataFrame:
    """``hits(query_id, rank, chunk_id, score)`` → one line a hit."""
    return _joined(hits, F.format_string("%d. %s  %.4f", "rank", F.col("chunk_id").cast("string"), F.col("score").cast("double")), "\n", "listing")


def fused_hit_lines(hits: DataFrame) -> DataFrame:
    """``hits(query_id, rank, chunk_id, rrf_score, vector_rank, bm25_rank)`` → one line a hit; ``-``: not in that list."""
    place = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    one = F.format_string("%d. %s  %.6f (vector %s, words %s)", "rank", F.col("chunk_id").cast("string"), F.col("rrf_score").cast("double"), place("vector_rank"), place("bm25_rank"))
    return _joined(hits, one, "\n", "listing")


def _joined(hits: DataFrame, one: Column, between: str, name: str) -> DataFrame:
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("_t")))).alias("_rows"))
    return rows.select("query_id", F.array_join(F.transform("_rows", lambda r: r["_t"]), between).alias(name))

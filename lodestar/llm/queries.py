"""The registered queries of the training-data operators: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.additive_quantisation import nearest
from lodestar.llm.best_fit_packing import pack_documents
from lodestar.llm.budget_mix import mix_sources
from lodestar.llm.common import delete_at_exit, fresh_path
from lodestar.llm.compression_bands import compression_bands
from lodestar.llm.host_rank import filter_sql, filter_urls
from lodestar.llm.item_spans import match_items, match_sql
from lodestar.llm.keyed_upsert import file_digests, upsert, write_table
from lodestar.llm.line_dedup import WHOLE, dedup_lines, dedup_sql
from lodestar.llm.repair_grammar import grammar_round_trip
from lodestar.llm.simhash_popcount import near_duplicates
from lodestar.llm.source_divergence import divergence_sql, source_divergence
from lodestar.llm.toxicity_gbt import score_toxicity
from lodestar.llm.warc_derivatives import derive, read_derived, responses_of_pages, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), WHOLE).select("doc_id", "text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")


def op4_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived from all pages, written as WARC files, and read back from them; a record that cannot be read is an error."""
    folder = fresh_path(spark, "warc")
    written = write_warc(derive(responses_of_pages(table(spark, sf_dir, "pages"))), folder)
    delete_at_exit(spark, folder)
    fails = F.raise_error(F.concat(F.lit("unreadable record in "), "path", F.lit(": "), "error")).cast("string")
    block = F.when(F.col("error").isNotNull(), fails).otherwise(F.col("block").cast("string"))
    return read_derived(written).withColumn("block", block).drop("path", "error").withColumnRenamed("source_id", "page_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences that the corpus pipeline ends in; the ids stay in the written table of its last stage."""
    return corpus_pipeline.run(spark, sf_dir).drop("ids")


def op10_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = grammar_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of the clients as sorted files, their changes applied to these; the files stay in the shared folder."""
    clients, changes = table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes")
    number = lambda c: F.crc32(F.col(c).cast("string"))
    most = 1 + clients.count() // 700
    folder = fresh_path(spark, "clients")
    files = write_table(clients.where(number("client_id") % 7 > 3), "client_id", most, folder)

    def decide(home: Column) -> Column:
        h = F.crc32(home.cast("string")) % 12
        gone = F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(number("change_id") % 8 < h, F.lit(False))
        return F.when(h <= 7, F.when(gone, "delete").otherwise("set"))

    columns = ["source", "segment", "city", "balance"]
    files = upsert(spark, folder, files, clients.schema, changes, "client_id", ["seq", "change_id"], columns, most, decide)
    return file_digests(spark, files, "client_id", "balance", ["source", "segment", "city"])


def op12_item_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_bands": op1_compression_bands,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_budget_mix": op4_budget_mix,
    "op5_toxicity_gbt": op5_toxicity_gbt,
    "op6_host_rank": op6_host_rank,
    "op7_simhash_popcount": op7_simhash_popcount,
    "op8_additive_quantisation": op8_additive_quantisation,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_repair_grammar": op10_repair_grammar,
    "op11_keyed_upsert": op11_keyed_upsert,
    "op12_item_spans": op12_item_spans,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op6_host_rank": filter_sql(),
    "op12_item_spans": match_sql(),
    "op13_source_divergence": divergence_sql(),
    "op3_line_dedup": f"WITH {dedup_sql('documents', rule=WHOLE)} SELECT id AS doc_id, txt AS text, n_lines, n_chunks, n_removed_chunks, n_removed_lines FROM deduped",
}

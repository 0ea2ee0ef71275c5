"""The corpus pipeline: stages that each apply one training-data operator to what its predecessor kept.

Every stage but the last returns the columns of ``documents``; each result is written as Parquet and read again as the
next one's input, so a lost executor never costs more than its stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.best_fit_packing import pack_documents
from lodestar.llm.budget_mix import apply_mix
from lodestar.llm.common import fresh_path
from lodestar.llm.line_dedup import WHOLE, dedup_lines
from lodestar.llm.simhash_popcount import drop_near_duplicates
from lodestar.llm.toxicity_gbt import drop_toxic
from lodestar.session import ship_code

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.select(COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents among its input."""
    ship_code(spark)
    return _documents(drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stood before go from the texts; ``n_chars`` follows the text. No document goes."""
    ship_code(spark)
    return _documents(dedup_lines(docs, WHOLE).withColumn("n_chars", F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship_code(spark)
    return _documents(drop_near_duplicates(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix stay, those that it takes twice as two rows."""
    ship_code(spark)
    return _documents(apply_mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences, with the ids of each piece."""
    ship_code(spark)
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", packing),
]

#: A fitted classifier and a knapsack are no SQL: the pipeline is tested stage by stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

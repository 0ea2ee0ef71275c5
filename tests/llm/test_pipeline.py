"""The pipeline stage by stage against what its stages promise, and the registered queries against SQL."""

import pytest
from pyspark.sql import functions as F

from lodestar.llm.queries import ORACLES, QUERIES
from tests.comparing import duck, rows_of_duck, rows_of_spark


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert rows_of_spark(QUERIES[name](spark, sf_dir)) == rows_of_duck(duck(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline", "op11_keyed_upsert"}))
def test_query_covers_its_table(spark, sf_dir, name):
    """One row for each document, page record or query, whatever the method decides."""
    got = QUERIES[name](spark, sf_dir).cache()
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "op8_additive_quantisation":
        asked = table("embeddings").where("vec_id % 20 = 0").count()
        assert got.select("query_id").distinct().count() == asked and got.count() == 20 * asked
    elif name == "op9_warc_derivatives":
        assert got.count() == 2 * table("pages").count() and got.select("record_id").distinct().count() == got.count()
    else:
        docs = table("documents")
        assert got.select("doc_id").distinct().count() == docs.count() and (name == "op2_best_fit_packing" or got.count() == docs.count())
    if name == "op2_best_fit_packing":
        total = got.agg(F.sum("length")).first()[0]
        assert got.select("sequence_id").distinct().count() <= 1.05 * total / 2048 + 1
    if name == "op10_repair_grammar":
        rows, at = got.orderBy("doc_id").collect(), 0
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
    got.unpersist()


def test_pipeline_query_ends_in_sequences(spark, sf_dir):
    got = QUERIES["pipeline"](spark, sf_dir)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and got.count() > 0


def test_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    from lodestar.llm.simhash_popcount import near_duplicates

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns, name
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "toxicity":
            toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0")
            assert after.join(toxic, "doc_id", "left_semi").count() >= 0.95 * before.join(toxic, "doc_id", "left_semi").count()
        elif name == "line dedup":
            assert after.count() == before.count() and after.where(F.length("text") != F.col("n_chars")).count() == 0
        elif name.startswith("SimHash"):
            groups = near_duplicates(before)
            assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
        elif name.startswith("mixing"):
            assert 0 < after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        before = after
    assert before.where("length > 2048 OR length < 1").count() == 0
    assert before.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0

"""The index against scores worked out without one, on rare and common terms, ties, empty texts and several indexes."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import inverted_index as I
from lodestar.operators import keyword_scan as K
from lodestar.operators.retrieval import bm25, top_k


def plain(chunks, queries, k, by=()):
    groups = [*by, "query_id"]
    return top_k(bm25(chunks, queries, by=list(by)), k, groups, F.desc("score"), F.asc("chunk_id")).select(*groups, "chunk_id", "score", "rank")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(i % 2, i // 2, text(rng.choice([1, 20, 80]))) for i in range(1200)] + [(0, 9000, None), (0, 9001, ""), (1, 9002, "w0 " * 500)]
    rows += [(0, 9100 + i, "w399 w398 tie") for i in range(30)]
    asked = [(i, text(rng.choice([1, 3, 10]))) for i in range(12)] + [(50, "w399 w399 tie"), (51, "absent words"), (52, ""), (53, None), (54, "w0"), (55, "absent w350"), (60, "w120 w0 w1 w2"), (61, "w90 w91")]
    return spark.createDataFrame(rows, "strategy int, chunk_id long, text string"), spark.createDataFrame(asked, "query_id long, question string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("cell", [8, 10_000])
def test_same_hits_as_without_index(spark, corpus, monkeypatch, cell):
    monkeypatch.setattr(I, "CELL", cell)
    chunks, queries = corpus
    one = chunks.where("strategy = 0").drop("strategy")
    index = I.build_index(one)
    index = I.open_index(spark, index.folder)
    assert index.exists(spark) and rows(I.search(index, queries, 7)) == rows(plain(one, queries, 7))
    if cell == 8:
        read, all_cells = I.cells_read(index, queries.where("query_id >= 60"), 3)
        assert read < all_cells / 2
        many = I.build_index(chunks, by=["strategy"])
        assert rows(I.search(many, queries, 3)) == rows(plain(chunks, queries, 3, ["strategy"]))
        filled = I.search(many, queries, 3, fill=True)
        assert filled.count() == 2 * 3 * queries.count()
        assert [tuple(r) for r in filled.where("query_id = 51 AND strategy = 1").orderBy("rank").collect()] == [(1, 51, c, 0.0, c + 1) for c in range(3)]


@pytest.mark.parametrize("block", [K.BLOCK, 900])
def test_scan_gives_the_hits_of_the_index(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    chunks, queries = corpus
    one = chunks.where("strategy = 0").drop("strategy")
    monkeypatch.setattr(K, "build_index", lambda *a, **b: pytest.fail("no index is built for few questions"))
    assert rows(K.keyword_scan(one, queries, 7)) == rows(plain(one, queries, 7))
    if block == 900:
        assert rows(K.keyword_scan(chunks, queries, 3, ["strategy"])) == rows(plain(chunks, queries, 3, ["strategy"]))
        full = K.keyword_scan(chunks, queries, 3, ["strategy"], fill=True)
        assert full.count() == 2 * 3 * queries.count()
        assert [tuple(r) for r in full.where("query_id = 51 AND strategy = 1").orderBy("rank").collect()] == [(1, 51, c, 0.0, c + 1) for c in range(3)]
        assert K.keyword_scan(one.limit(0), queries, 5).count() == 0 and K.keyword_scan(one.limit(20), queries.limit(0), 5).count() == 0
        monkeypatch.undo()
        monkeypatch.setattr(K, "MOST_CELLS", 1)
        assert rows(K.keyword_scan(one, queries, 7)) == rows(plain(one, queries, 7))


def test_empty_table(spark, corpus):
    chunks, queries = corpus
    index = I.build_index(chunks.limit(0).drop("strategy"))
    assert I.search(index, queries, 5).count() == 0
    assert I.search(I.build_index(chunks.limit(20).drop("strategy")), queries.limit(0), 5).count() == 0
